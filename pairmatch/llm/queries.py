"""Registered queries of the training-data operators, each over its whole table with the
operator's production parameters, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode
from .chat import format_log, read_back, turn_events
from .common import table
from .exact import dedup_stream
from .fptree import search
from .html import extract_main_text
from .lm import score_texts
from .lines import MAX_RATIO, MIN_PAGES, site_line_dedup
from .minhash import near_duplicates
from .packing import pack
from .pieces import encode as encode_pieces
from .quality import quality_rules
from .substring import remove_repeats
from .whiten import whiten

DEFAULT_VOCABULARY = "word_bpe_49k.json"


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op2_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(DEFAULT_VOCABULARY), with_ids=False)


# The conversation that the formatting query adds to the table (fixed value).
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def with_control_conversation(turns: DataFrame) -> DataFrame:
    """The table's turns plus conversation -7, whose texts hold the template's control strings."""
    rows = turns.select("conv_id", "turn", "role", "text")
    own = rows.sparkSession.createDataFrame(
        [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], rows.schema)
    return rows.unionByName(own)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = turn_events(with_control_conversation(table(spark, sf_dir, "conversations")))
    r = read_back(format_log(log))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return r.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
                    F.char_length("loss_text").cast("long").alias("loss_chars"),
                    F.sha2("loss_text", 256).alias("loss_sha256"),
                    F.char_length("formatted").cast("long").alias("formatted_chars"))


# DuckDB strings have no escapes: a backslash in the SQL is one character.
_ESCAPED = "replace(replace(replace({}, '\\', '\\b'), '<', '\\l'), '#', '\\h')"
SQL_CHAT = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL_TEXT}')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(14 + length(replace({_ESCAPED.format('role')}, ':', '\\c')) + length({_ESCAPED.format('text')}))::BIGINT
           AS formatted_chars
FROM t GROUP BY conv_id"""


def op4_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_stream(spark, f"{sf_dir}/documents.parquet").drop("file", "row")


SQL_DEDUP = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
           FROM documents),
g AS (SELECT norm, count(*) AS group_size, min_by(doc_id, (-n, doc_id)) AS keep_id FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.norm) AS text_sha256 FROM d JOIN g USING (norm)"""


def op5_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = remove_repeats(table(spark, sf_dir, "documents"), want=("kept",))
    return r.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL_REPEATS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM k) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM r),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
y AS (SELECT x.doc_id, count(c.j) AS n_removed, string_agg(word, ' ' ORDER BY x.j) FILTER (c.j IS NULL) AS kept
      FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.j = c.j GROUP BY x.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN y USING (doc_id)"""


def op6_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return r.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "kept", "score")


def op7_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return r.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                    F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = site_line_dedup(table(spark, sf_dir, "documents"))
    return r.select("doc_id", "source", F.sha2("text", 256).alias("text_sha256"), "n_lines", "n_dropped")


SQL_LINES = f"""
WITH p AS (SELECT row_number() OVER () AS r, doc_id, source, text, coalesce(md5(text), '') AS page FROM documents),
l AS (SELECT r, doc_id, source, page, unnest(string_split(text, chr(10))) AS line,
             unnest(range(len(string_split(text, chr(10))))) AS i FROM p),
t AS (SELECT source, count(DISTINCT page) AS total FROM p GROUP BY source),
b AS (SELECT source, line FROM (SELECT DISTINCT source, page, line FROM l WHERE trim(line) <> '') JOIN t USING (source)
      GROUP BY source, line, total HAVING count(*) >= {MIN_PAGES} AND count(*) > {MAX_RATIO}::DOUBLE * total),
k AS (SELECT l.r, count(*) AS n_lines, count(b.line) AS n_dropped,
             coalesce(string_agg(l.line, chr(10) ORDER BY i) FILTER (b.line IS NULL), '') AS kept
      FROM l LEFT JOIN b ON l.source = b.source AND l.line = b.line GROUP BY l.r)
SELECT doc_id, source, sha256(kept) AS text_sha256, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped
FROM p LEFT JOIN k USING (r)"""


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_fp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
SQL_SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
q AS (SELECT i, item_id, unnest(list_distinct(t)) AS term FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS t FROM benchmark)),
g AS (SELECT count(*) FILTER (len(t) > 0)::BIGINT AS n, sum(len(t))::BIGINT AS l FROM d),
f AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM d)
      WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
      FROM (SELECT term, count(*)::BIGINT AS df FROM f GROUP BY term), g),
m AS (SELECT r, doc_id, 100 - 50 + ((50 * len(t)::BIGINT * n) // l) AS m FROM d, g WHERE len(t) > 0),
s AS (SELECT i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN f USING (term) JOIN m USING (r) GROUP BY i, item_id, r, doc_id)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0) WHERE rank <= 50"""


def op13_piece_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return r.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                    F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                    F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_pitman_yor, op2_retrieval_packing, op3_chat_format, op4_stream_dedup,
                                   op5_seed_extend, op6_quality_forest, op7_bag_minhash, op8_main_text,
                                   op9_byte_bpe, op10_line_dedup, op11_whitening, op12_fp_tree, op13_piece_backtracking)}
ORACLE = {"op3_chat_format": SQL_CHAT, "op4_stream_dedup": SQL_DEDUP, "op5_seed_extend": SQL_REPEATS,
          "op10_line_dedup": SQL_LINES, "op12_fp_tree": SQL_SEARCH}
