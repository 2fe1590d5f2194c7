"""Table shapes.  Every table of ordered text has a video_id: all rules work per video."""

FRAMES = "video_id string, frame_index int, timestamp_sec double, boxes array<struct<text:string,confidence:double,polygon:array<struct<x:int,y:int>>>>"
CUES = "video_id string, idx int, text string, start_sec double, end_sec double, confidence double, frame_count int, position struct<x:int,y:int>, bbox struct<x0:int,y0:int,x1:int,y1:int>, uid string"
CUE = "video_id string, idx int, text string, start_sec double, end_sec double, confidence double, frame_count int"
LINES = "job_id string, idx int, start_ms bigint, end_ms bigint, source string, target string, prev_target string, speaker string, addressee string, scene string"
GLOSSARY = "job_id string, source_term string, target_term string"
BOXES = "video_id string, frame_idx int, timestamp_sec double, x_min double, y_min double, x_max double, y_max double, confidence double, text string"
MEMORY = "series_key string, source_text string, target_text string, updated_at timestamp"
OCR_FILE = "version string, meta struct<video_name:string,video_duration_sec:double,frame_count:int,sample_step_sec:double,detection_model:string,recognition_model:string,score_threshold:double,saved_at:string,roi_xywh:array<int>,app_version:string>, frames array<struct<fi:int,ts:double,boxes:array<struct<t:string,c:double,p:array<array<int>>>>>>"
SPEECH_FILE = "version string, meta struct<media_path:string,detected_language:string,model_size:string,segment_count:int,word_count:int>, segments array<struct<start:double,end:double,text:string,speaker:string,words:array<struct<word:string,start:double,end:double,score:double>>>>"
