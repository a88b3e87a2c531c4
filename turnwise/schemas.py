"""Schemas of the data model: flat, keyed tables in place of nested documents."""

TURNS = "clip_id string, system string, turn_idx bigint, speaker string, start double, end double"
SEGMENTS = "clip_id string, seg_idx bigint, speaker string, start double, end double, text string"
WORDS = "clip_id string, system string, word_idx bigint, text string, start double, end double"
SEGMENT_CSV = "video_id string, start_sec double, end_sec double, youtube_link string, diarization_segments string, asr_segments string"
ASR_PAYLOAD = (
    "clip_id string, system string, status string, strategy string, diar_model string, merge_gap double, "
    "clip_dur_sec double, n_words bigint, elapsed_sec double, rtf double, settings_key string, segmentation string, "
    "segments array<struct<i:bigint,start:double,end:double,speaker:string,text:string,skipped:string,lang:string>>, "
    "words array<struct<t:string,s:double,e:double>>"
)
SIDECAR = "model string, clip_id string, status string, oracle boolean, n_turns bigint, n_speakers_hyp bigint, clip_dur_sec double, elapsed_sec double, rtf double"
#: Columns that tell the truth about a clip begin like this; inputs of a system must not have them.
TRUTH_PREFIXES = ("gt_", "n_gt_", "ref_")
METRICS = (
    "model string, clip_id string, der double, der_fa_sec double, der_miss_sec double, der_confusion_sec double, "
    "der_correct_sec double, der_total_sec double, jer double, n_speakers_ref bigint, n_speakers_hyp bigint, "
    "speaker_count_error bigint, speaker_count_correct int, overlap_der double, single_speaker_der double"
)
