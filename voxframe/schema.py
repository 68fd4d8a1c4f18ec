"""Explicit schemas of the engine's inputs; nothing is inferred."""

SEGMENTS = "signal_id string, idx int, start_sec double, end_sec double"
PROBS = "signal_id string, w int, p double, duration_sec double"
TIMED = "doc_id string, idx int, start_sec double, end_sec double, text string, speaker string"
TURNS = "item_id string, speaker string, start_sec double, end_sec double"
EMBEDDINGS = "vec_id int, embedding array<float>"
RESULTS = "run_id string, seq long, model string, backend string, item_id string, status string, infer_ms double, rtf double, load_ms double, mem_peak_mb double, sub int, del int, ins int, ref_words int, hyp_words int, hypothesis string, error string"
MANIFEST = (
    "version string, createdAt string, seed long, sources array<struct<name:string,url:string,license:string>>, "
    "items array<struct<id:string,url:string,lang:string,durationSec:double,condition:string,reference:string,sha256:string,level:string,split:string,snrDb:double,speakers:int,clips:int>>"
)
TIMELINE = "note string, builtBy string, seed long, items array<struct<id:string,sha256:string,durationSec:double,overlapSec:double,speakers:array<string>,turns:array<struct<speaker:string,startSec:double,endSec:double>>>>"
SESSIONS = "session_id string, name string, created_at timestamp, lang string, duration_sec double, has_audio boolean, speaker_count int"
STORED_SEGMENTS = "session_id string, idx int, start_sec double, end_sec double, text string, speaker string, edited boolean"
CHUNKS = "file_key string, block_index int, segments array<struct<start_sec:double,end_sec:double,text:string>>"
RUNS = "file_key string, done_blocks int, total_blocks int, updated_at timestamp"
QUEUE = "key string, name string, estado string, session_id string, error string"
LEARNED = "map<string,array<double>>"
