"""Schemas of the domain tables. Times are microseconds of a media's clock, never timestamps."""

CUES = "media_id string, cue_no int, start_us bigint, end_us bigint, text string, style string, actor string"
FILES = "path string, content string"

REFERENCE_DOCUMENT = (
    "success boolean, reference_audio_segments array<struct<index:int,text:string,start_time:double,end_time:double,duration:double,file_path:string,"
    "quality_score:double,sample_rate:int,audio_length:bigint,is_silence:boolean,replaced_with:int>>"
)
SYNTHESIS_DOCUMENT = (
    "success boolean, tts_audio_segments array<struct<index:int,text:string,reference_file:string,tts_file:string,duration:double,sample_rate:int,"
    "is_empty:boolean,tts_generated:boolean,file_size:bigint>>, total_segments int, successful_segments int, failed_segments int, failed_segment_indices array<int>"
)
ALIGNMENT_DOCUMENT = (
    "success boolean, total_duration double, aligned_audio_segments array<struct<index:int,text:string,start_time:double,end_time:double,duration:double,"
    "file_path:string,is_silence:boolean,sample_rate:int,audio_length:bigint,file_size:bigint,segment_type:string,silence_reason:string>>"
)
STEP_STATUS = (
    "struct<step_id:int,status:string,started_at:string,completed_at:string,progress_percent:double,current_item:int,total_items:int,"
    "error_message:string,result_files:array<string>,metadata:map<string,string>>"
)
TASK_STATE = (
    "task_id string, video_path string, subtitle_path string, current_step int, status string, progress double, created_at string, updated_at string, "
    "started_at string, completed_at string, error_message string, retry_count int, max_retries int"
)
STATUS_EVENT = (
    "event_type string, task_id string, step_id int, status string, message string, progress double, current_item int, total_items int, "
    "error_message string, event_time timestamp, sequence bigint"
)

#: The ordered steps of a run.
STEPS = [
    (0, "preprocess_subtitle"), (1, "separate_media"), (2, "generate_reference_audio"), (3, "generate_tts"),
    (4, "align_audio"), (5, "generate_aligned_srt"), (6, "process_video_speed"), (7, "merge_audio_video"),
]
