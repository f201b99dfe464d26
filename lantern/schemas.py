"""Row types of the retrieval and verification tables."""

CHUNK = "chunk_id bigint, document_id bigint, subject_id int, unit string, ord int, kind string, text string, context string, tokens int, embedding array<float>"
DOCUMENT = "document_id bigint, subject_id int, path string, sha256 string, licence string, planted boolean, source_date date"
SUBJECT = "subject_id int, degree string, year smallint, name string, code string"
BRIDGE = "degree string, subject_id int, name string, year smallint, hours int, norm string"
GLOSSARY = "subject_id int, term string, definition string, chunk_id bigint"
REQUEST = "request_id bigint, ts timestamp, mode string, subject_id int, text string, version_prompt string"
RESPONSE = "response_id bigint, request_id bigint, ttft_ms bigint, total_ms bigint, tokens_in bigint, tokens_out bigint, cost decimal(10,6), stages string, abstained boolean"
CLAIM = "claim_id bigint, response_id bigint, type string, text string, chunk_id bigint, verdict string, detail string"
CANDIDATE = "query_id bigint, list string, chunk_id bigint, subject_id int, score double"
EMBEDDING = "document string, ord int, subject int, vector array<float>"
