"""The registered queries of this subpackage and, where SQL can say it, the equivalent SQL."""

from __future__ import annotations

import corpus_pipeline
from corpusloom.llm import archives, chats, exact, lexical, lines, mixing, multiindex, packing, pages, repair, rules, simhash, urls
from corpusloom.llm.common import table
from corpusloom.plans.catalog import Item

EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

ARCHIVE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
  FROM pages
)
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::INTEGER >> (5 * (3 - i % 4))::INTEGER) & 31)::INTEGER, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p
"""

SEARCH_SQL = r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), sized AS (SELECT doc_id, words, len(words) AS n, row_number() OVER () AS doc FROM lowered WHERE len(words) > 0),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM sized),
tf AS (SELECT doc, word, count(*) AS tf FROM (SELECT doc, unnest(words) AS word FROM sized) GROUP BY ALL),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS word FROM benchmark
), scored AS (
  SELECT item_id, doc_id, doc, sum(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT
    * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total))))::BIGINT AS score
  FROM asked JOIN df USING (word) JOIN tf USING (word) JOIN sized USING (doc) CROSS JOIN whole
  GROUP BY item_id, doc_id, doc
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def items() -> dict[str, Item]:
    return {
        "op1_simhash": Item(lambda spark, sf: simhash.near_duplicates(table(spark, sf, "documents"))),
        "op2_line_dedup": Item(
            lambda spark, sf: lines.delete_repeated_runs(table(spark, sf, "documents")).select("doc_id", "text", "n_removed")
        ),
        "op4_exact_dedup": Item(lambda spark, sf: exact.exact_duplicates(table(spark, sf, "documents")), EXACT_SQL),
        "op3_mixing": Item(lambda spark, sf: mixing.schedule(table(spark, sf, "documents"))),
        "op6_url_filter": Item(lambda spark, sf: urls.judge_urls(table(spark, sf, "pages"))),
        "op7_quotation_links": Item(lambda spark, sf: chats.link_quotes(table(spark, sf, "conversations"))),
        "pipeline": Item(corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
        "op5_packing": Item(lambda spark, sf: packing.pack_documents(table(spark, sf, "documents"))),
        "op9_quality_rules": Item(
            lambda spark, sf: rules.judge(table(spark, sf, "documents"), table(spark, sf, "labels")).select(
                "doc_id", *rules.COUNTS[:5], "base_failed", "kept"
            )
        ),
        "op11_conversation_repair": Item(lambda spark, sf: repair.damaged_and_repaired(table(spark, sf, "conversations"))),
        "op12_ranked_search": Item(lambda spark, sf: lexical.ranked_search(table(spark, sf, "benchmark"), table(spark, sf, "documents")), SEARCH_SQL),
        "op13_embedding_near_dedup": Item(lambda spark, sf: multiindex.near_duplicate_vectors(table(spark, sf, "embeddings"))),
        "op10_main_text": Item(lambda spark, sf: pages.main_texts(table(spark, sf, "pages"))),
        "op8_warc": Item(
            lambda spark, sf: archives.archive_pages(table(spark, sf, "pages")).select(
                "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
            ),
            ARCHIVE_SQL,
        ),
    }
