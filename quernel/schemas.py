"""Schemas of the engine's tables."""

DOCUMENTS = "id string, name string, origin string, bytes bigint, added timestamp, text string"
PASSAGES = "doc_id string, doc_name string, chunk_no int, text binary, n_tokens int, chunk_hash string"
POSTINGS = "term string, doc_id string, chunk_no int, tf int, n_tokens int"
VECTORS = "model string, dim int, doc_id string, chunk_hash string, vec array<float>"
SKIPPED = "model string, chunk_hash string"
CHATS = "id string, v int, model string, created timestamp"
MESSAGES = "chat_id string, pos int, role string, content string, ts timestamp, sources array<string>"
LOCK = "kind string, repo string, rev string, file string, bytes bigint, sha256 string, profile int"
