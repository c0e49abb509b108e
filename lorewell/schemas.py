"""The tables' schemas. Nothing is inferred."""

from __future__ import annotations

DOCS = "doc_id long, path string, file_title string, kind string, md_content string"
SECTIONS = "doc_id long, sec_no int, level int, title string, body string, file_title string, parent_title string"
CHUNKS = "chunk_id long, doc_id long, chunk_no int, title string, content string, file_title string, parent_title string, item_name string, dense_vector array<float>, sparse_vector map<long,float>"
ITEM_NAMES = "doc_id long, file_title string, item_name string, dense_vector array<float>, sparse_vector map<long,float>"
MESSAGES = "message_id string, session_id string, role string, text string, rewritten_query string, item_names array<string>, ts double"
TASK_EVENTS = "task_id string, node string, event string, ts timestamp, duration double"
EXTRACTION = "item_names array<string>, rewritten_query string"
WEB_REPLY = "pages array<struct<snippet:string,title:string,url:string>>"
