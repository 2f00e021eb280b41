"""Schemas of the engine's tables."""

IMAGES = "array<struct<url:string,alt:string>>"
RECORDS = f"url string, title string, text string, links array<string>, images {IMAGES}, published bigint"
POSTINGS = "term string, doc_id bigint, tf_title int, tf_body int, positions array<int>"
PASSAGES = "doc_id bigint, passage_idx int, text string, embedding array<float>"
EDGES = "src bigint, dst bigint"
QUERIES = "query_id bigint, q string"
HITS = f"query_id bigint, rank int, url string, title string, score double, published bigint, fresh_label string, snippet string, images {IMAGES}, answer string"
QRELS = "query_id bigint, url_pattern string, grade int"
SEARCH_LOG = "ts timestamp, query string, results int, elapsed_ms bigint"
CLICK_LOG = "ts timestamp, query string, url string"
PAGE_JSON = "array<struct<url:string,title:string,text:string,published:string>>"
