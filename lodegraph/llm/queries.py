"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodegraph.llm import langid, licenses, line_dedup, media, ngram_join, packing, pieces, quality, secrets, warc
from lodegraph.llm.common import read


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(read(spark, sf_dir, "documents")))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(read(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.dedup_lines(read(spark, sf_dir, "documents")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.apply_rules(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.predict(docs, langid.learn(docs))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_bundles(*warc.write_bundles(read(spark, sf_dir, "pages")))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding's picture, and the edited copies, against each other."""
    return media.copies(media.pictures(read(spark, sf_dir, "embeddings")))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_pieces, op3_ngram_join, op4_packing, op5_line_dedup, op6_quality, op7_langid, op8_warc, op9_licenses, op10_media)}

#: The white space that keys lose at both ends.
WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"



def _secrets_sql() -> str:
    """All kinds' matches with their places: a match starts after the gaps and matches before it."""
    parts = []
    for rank, r in enumerate(secrets.RULES):
        expression = r.regex.replace("'", "''")
        if "(?i:" in expression:  # letters A to Z only
            head, _, rest = expression.partition("(?i:")
            word, _, rest = rest.partition("))")
            expression = head + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word) + ")" + rest
        size = f"length(regexp_extract(s, '{expression}', {r.group}))" if r.group else "length(s)"
        parts.append(f"""select doc_id, {rank} as rank, '{r.kind}' as kind, start, start + length(s) as stop from (
  select doc_id, m[i] as s, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as start
  from (select doc_id, regexp_extract_all(tx, '{expression}') as m, string_split_regex(tx, '{expression}') as g from d) q, unnest(range(1, len(m) + 1)) as u(i)) where {size} >= {r.least}""")
    line = "kind || ':' || cast(start as bigint) || ':' || cast(stop as bigint)"
    return f"""with d as (select doc_id, coalesce(text, '') as tx from documents), f as ({' union all '.join(parts)})
select doc_id, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex,
       sha256(coalesce(string_agg({line}, ',' order by start, rank) filter (rank < 3), '')) as base_sha256,
       coalesce(string_agg({line}, ',' order by start, rank) filter (rank is not null), '') as spans
from d left join f using (doc_id) group by doc_id"""


ORACLES = {
    "op1_secrets": _secrets_sql(),
    "op5_line_dedup": f"""
with lines as (
  select doc_id, n, line, translate(trim(line, {WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
               unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as n from documents)),
first as (select k, min(doc_id) as f from lines where length(k) >= 10 group by k having count(distinct doc_id) > 1),
marked as (select doc_id, n, line, coalesce(doc_id <> f, false) as gone from lines left join first using (k))
select doc_id, count(*) as n_lines, cast(count(*) filter (gone) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by n) filter (not gone), '')) as kept_sha256
from marked group by doc_id""",
    "op8_warc": """
with p as (select page_id, coalesce(html, '') as h, sha256(coalesce(html, '')) as d from pages),
f as (select d, min(page_id) as first from p where strlen(h) >= 100 group by d)
select page_id, strlen(h) as payload_bytes, p.d as payload_digest,
       case when first < page_id then 'revisit' else 'response' end as record_type,
       case when first < page_id then first end as refers_to
from p left join f on p.d = f.d and strlen(h) >= 100""",
}
