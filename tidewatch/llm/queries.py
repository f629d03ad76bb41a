"""The queries of the training-data operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tidewatch.llm import pii
from tidewatch.llm.ann import nearest
from tidewatch.llm.common import materialize, table
from tidewatch.llm.convo_trie import prefix_trie
from tidewatch.llm.fill_middle import fill_in_middle
from tidewatch.llm.lang_id import identify
from tidewatch.llm.licences import scan_licences
from tidewatch.llm.line_dedup import dedup_lines
from tidewatch.llm.ngram_join import jaccard_components
from tidewatch.llm.packing import pack_by_curve, vocabulary
from tidewatch.llm.pieces import checksum, decode_ids, encode_texts, load_pieces
from tidewatch.llm.quality import fertility_rules
from tidewatch.llm.toxicity import score_toxicity
from tidewatch.llm.warc import read_bundles, write_bundles


def bpe_vocabulary(spark, path=public_tokenizers.path):
    return vocabulary(spark, path("byte_bpe_50k.tiktoken"), path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def rule_vocabularies(spark, path=public_tokenizers.path):
    return [vocabulary(spark, path(name), None, public_tokenizers.PATTERN) for name in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")]


def rule_pieces(spark, path=public_tokenizers.path):
    """The pieces of the vocabulary with byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    return spark.sparkContext.broadcast([model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_byte(i)])


def op1_ngram_jaccard_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"), size=5, percent=80)


def op2_warc_bundles(spark, sf_dir):
    bundles = materialize(write_bundles(table(spark, sf_dir, "pages"), min_bytes=100), "warc", "none")
    return read_bundles(bundles).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def piece_vocabulary(spark, path=public_tokenizers.path):
    return spark.sparkContext.broadcast(load_pieces(path("piece_bpe_32k.model"), "bpe"))


def op3_sentencepiece(spark, sf_dir):
    pieces = piece_vocabulary(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("text_sha256", F.sha2(F.encode("text", "UTF-8"), 256))
    encoded = checksum(encode_texts(docs, pieces)).drop("text")
    decoded = F.sha2(F.encode("text", "UTF-8"), 256)
    return decode_ids(encoded, pieces).select("doc_id", "n_ids", "ids_crc32", decoded.alias("decoded_sha256"), F.coalesce(decoded == F.col("text_sha256"), F.col("n_ids") == 0).alias("round_trip"))


def op4_licence_scan(spark, sf_dir):
    found = scan_licences(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("licences", lambda x: F.concat_ws(":", x["family"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", "families", "n_licences", "n_unknown", spans.alias("licence_spans"))


def op5_additive_quantisation(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op6_quality_fertility(spark, sf_dir):
    return fertility_rules(table(spark, sf_dir, "documents"), rule_vocabularies(spark), rule_pieces(spark))


def op7_hilbert_packing(spark, sf_dir):
    return pack_by_curve(table(spark, sf_dir, "documents"), bpe_vocabulary(spark), length=2048)


def op8_pii_boosting(spark, sf_dir):
    found = pii.find_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    digest = F.sha2(F.encode(pii.span_text(F.col("base_spans")), "UTF-8"), 256)
    return found.select("doc_id", *[count(k) for k in pii.BASE], digest.alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"))


def op9_line_dedup(spark, sf_dir):
    out = dedup_lines(table(spark, sf_dir, "documents"), min_chars=20, min_docs=3)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op10_byte_gru_language(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))


def op11_toxicity_machine(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_fill_in_middle(spark, sf_dir):
    return fill_in_middle(table(spark, sf_dir, "documents")).drop("output")


def op13_conversation_trie(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_warc_bundles, op3_sentencepiece, op4_licence_scan, op5_additive_quantisation, op6_quality_fertility, op7_hilbert_packing, op8_pii_boosting, op9_line_dedup, op10_byte_gru_language, op11_toxicity_machine, op12_fill_in_middle, op13_conversation_trie)}
_LINES = """
    SELECT doc_id, line, i, lower_ascii AS key
    FROM (
        SELECT doc_id, i, line,
               translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii
        FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
    )
"""

#: DuckDB SQL of the operators that SQL can express over whole tables.
SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ),
        s AS (
            SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS shingle FROM w
        ),
        d AS (SELECT DISTINCT doc_id, shingle FROM s),
        n AS (SELECT w.doc_id, count(shingle) AS n FROM w LEFT JOIN d USING (doc_id) GROUP BY ALL),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM d a JOIN d b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        r AS (SELECT doc_id, doc_id AS seen FROM n UNION SELECT r.doc_id, ways.b FROM r JOIN ways ON ways.a = r.seen)
        SELECT n.doc_id, n.n AS n_shingles, min(r.seen) AS component_id FROM n JOIN r USING (doc_id) GROUP BY ALL
    """,
    "op5_additive_quantisation": """
        WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
        u AS (SELECT vec_id, v FROM v WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score FROM u q JOIN u c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS rank FROM s) WHERE rank <= 5
    """,
    "op2_warc_bundles": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        d AS (SELECT page_id, strlen(payload) AS payload_bytes, sha256(payload) AS payload_digest, min(page_id) OVER (PARTITION BY payload) AS first_id FROM p)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to
        FROM d
    """,
    "op12_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
        c AS (
            SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS low, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS high,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
            FROM u
        ),
        p AS (SELECT doc_id, text, n, form, array_to_string(units[1:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle, array_to_string(units[high + 1:], '') AS suffix FROM c)
        SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p
    """,
    "op13_conversation_trie": r"""
        WITH t AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
            FROM conversations WHERE conv_id IS NOT NULL
        ),
        x AS (SELECT conv_id, i, sha256(strlen(role) || ':' || role || text) AS s, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS words FROM t),
        c AS (
            SELECT conv_id, conv_id - conv_id % 20 AS base, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, len(CAST(conv_id AS VARCHAR)) + 1), lambda j: CAST(ascii(substr(CAST(conv_id AS VARCHAR), j, 1)) AS BIGINT))),
                   lambda acc, byte: list_reduce(list_prepend(xor(acc, byte), CAST(range(0, 8) AS BIGINT[])), lambda v, bit: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END))) % 4 AS h
            FROM (SELECT DISTINCT conv_id FROM t)
        ),
        r AS (
            SELECT c.conv_id, 0 AS part, x.i, x.s, x.words FROM c JOIN x ON x.conv_id = c.base AND x.i <= c.h
            UNION ALL SELECT c.conv_id, 1, x.i, x.s, x.words FROM c JOIN x ON x.conv_id = c.conv_id AND x.i > c.h
        ),
        o AS (SELECT c.conv_id, coalesce(l, []) AS l, coalesce(w, []) AS w FROM c LEFT JOIN (SELECT conv_id, list(s ORDER BY part, i) AS l, list(words ORDER BY part, i) AS w FROM r GROUP BY conv_id) USING (conv_id)),
        e AS (SELECT conv_id, d, sha256(array_to_string(l[1:d], ',')) AS node, sha256(array_to_string(l[1:d - 1], ',')) AS above, CASE WHEN d > 0 THEN w[d] ELSE 0 END AS words, len(l) = d AS last, l FROM (SELECT *, unnest(range(0, len(l) + 1)) AS d FROM o)),
        n AS (
            SELECT node, min(conv_id) AS conv_id, min(d) AS depth, any_value(above) AS above, count(*) AS n_convs, any_value(words) AS words, any_value(l[1:d]) AS l,
                   sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
            FROM e GROUP BY node
        ),
        k AS (SELECT above AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY above),
        f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (node)),
        sub AS (SELECT sha256(array_to_string(l[1:j], ',')) AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS j FROM f) GROUP BY ALL)
        SELECT f.conv_id, f.depth::BIGINT AS depth, CASE WHEN f.depth > 0 THEN p.conv_id END AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
        FROM f JOIN sub USING (node) LEFT JOIN f p ON p.node = f.above
    """,
    "op9_line_dedup": f"""
        WITH l AS ({_LINES}),
        common AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        marked AS (SELECT l.*, common.key IS NOT NULL AND l.doc_id <> common.keeper AS gone FROM l LEFT JOIN common USING (key))
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
}
