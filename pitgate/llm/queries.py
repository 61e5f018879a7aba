"""The registered queries of the operators, each over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitgate.llm import imatch, langid, toxicity
from pitgate.llm.gnat_tree import hard_negatives
from pitgate.llm.html_blocks import main_texts
from pitgate.llm.kmeans_tree import neighbours
from pitgate.llm.log_templates import without_templates
from pitgate.llm.merkle import dataset_proofs, folded, leaf_digest, siblings_digest
from pitgate.llm.mixing import mixed_words
from pitgate.llm.ngram_join import ngram_components
from pitgate.llm.packing import packed_documents
from pitgate.llm.setsketch import sketch_components
from pitgate.llm.suffix_dedup import repeated_spans

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def tokenizer(name: str) -> str:
    """Where the vocabulary file of a public tokenizer is; the file is the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_ngram_jaccard_join", """
WITH w AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\\x20\\x09-\\x0D]+') AS ws FROM documents WHERE text IS NOT NULL),
s AS (
    SELECT doc_id, list_distinct(CASE
        WHEN len(ws) = 0 THEN []
        WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g
    FROM w),
n AS (SELECT doc_id, len(g) AS n FROM s),
e AS (SELECT doc_id, unnest(g) AS g FROM s),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
    JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
    WHERE 10 * least(na.n, nb.n) >= 9 * greatest(na.n, nb.n)
    GROUP BY a.doc_id, b.doc_id, na.n, nb.n
    HAVING 100 * count(*) >= 90 * (na.n + nb.n - count(*))),
reach AS (
    WITH RECURSIVE r(doc_id, root) AS (
        SELECT doc_id, doc_id FROM documents
        UNION SELECT l.b, r.root FROM r JOIN links l ON l.a = r.doc_id)
    SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, reach.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id)""")
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose three-word shingles overlap by 90 % or more."""
    docs = table(spark, sf_dir, "documents")
    return ngram_components(docs, n=3, percent=90).select("doc_id", "n_shingles", "component_id")


@query("op8_suffix_array_dedup")
def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the bytes of strings of 200 bytes that occur more than once."""
    found = repeated_spans(table(spark, sf_dir, "documents"), length=200)
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_best_fit_packing")
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 4096 tokens."""
    return packed_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), keep_ids=False)


@query("op7_mixing_sources")
def op7_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words a mix with weights 1, 2, 3 takes of each document."""
    return mixed_words(table(spark, sf_dir, "documents"))


def remainder(of: int) -> Column:
    """crc32 of the document id as text, modulo ``of``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of))


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(remainder(4) != 2))
    found = langid.with_language(docs, model, keep=["doc_id"])
    return found.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How toxic every document is, learned from four fifths of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    taught = docs.select("doc_id", "text").join(labels, "doc_id").where(remainder(5) != 0)
    found = toxicity.toxic_scores(docs, toxicity.train(taught))
    return found.select("doc_id", (remainder(5) == 0).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op10_html_extraction")
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = main_texts(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


@query("op2_document_fingerprints")
def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    docs = table(spark, sf_dir, "documents")
    return imatch.edited_likeness(docs, imatch.lexicon(docs))


@query("op3_nearest_neighbours")
def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours(vectors, vectors.where(F.col("vec_id") % 50 == 0))


@query("op4_line_dedup", """
WITH t AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL),
raw AS (SELECT text, unnest(string_split(text, chr(10))) AS raw,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM t),
tidy AS (SELECT text, pos, trim(regexp_replace(raw, '[ \\t\\r]+', ' ', 'g'), ' ') AS line FROM raw),
tok AS (SELECT text, pos, list_transform(string_split(line, ' '),
               lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS ws FROM tidy),
l AS (SELECT text, pos, ws, array_to_string(ws, ' ') AS line,
             len(ws) || ':' || array_to_string(ws[1:3], ' ') AS leaf FROM tok WHERE len(ws) >= 3),
k AS (SELECT leaf, line, any_value(ws) AS ws, count(DISTINCT text) AS n_docs FROM l GROUP BY leaf, line),
modal AS (SELECT leaf, ws AS modal FROM k
          QUALIFY row_number() OVER (PARTITION BY leaf ORDER BY n_docs DESC, line) = 1),
members AS (
    SELECT k.leaf, k.line FROM k JOIN modal USING (leaf)
    WHERE 10 * len(list_filter(range(1, len(ws) + 1), lambda i: ws[i] = modal[i] AND ws[i] <> '<*>')) >= 6 * len(ws)),
belonging AS (SELECT l.text, l.pos, l.leaf FROM l JOIN members USING (leaf, line)),
often AS (SELECT leaf FROM belonging GROUP BY leaf HAVING count(DISTINCT text) >= 10),
gone AS (SELECT text, list(pos) AS gone FROM belonging JOIN often USING (leaf) GROUP BY text)
SELECT doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines,
       coalesce(len(gone), 0)::BIGINT AS n_dropped,
       CASE WHEN gone IS NULL THEN d.text ELSE array_to_string(list_transform(
           list_filter(range(len(string_split(d.text, chr(10)))), lambda i: NOT list_contains(gone, i)),
           lambda i: string_split(d.text, chr(10))[i + 1]), chr(10)) END AS text
FROM documents d LEFT JOIN gone ON gone.text = d.text""")
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines whose template ten documents share."""
    found = without_templates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), "text")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query("op13_merkle_manifest", f"""
WITH RECURSIVE enc AS (
    SELECT doc_id, coalesce('=' || lang, '') AS tree,
           coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
           text, translate(text, '{UPPER}', '{LOWER}') AS low,
           list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''),
               lambda c: ascii(c)::BIGINT)), lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)),
               lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
    FROM documents),
base AS (
    SELECT row_number() OVER () AS id, doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
           CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN sha256(head || coalesce(strlen(low) || ':' || low, '-'))
                ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS claim
    FROM enc),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
           count(*) OVER (PARTITION BY tree) AS n FROM base),
nodes(tree, level, pos, h, n) AS (
    SELECT tree, 0, pos, leaf, n FROM placed
    UNION ALL
    SELECT tree, level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8
    FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 8, n),
subs AS (
    SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(level, pos, h, n) AS (
    SELECT 0, pos, h, n FROM subs
    UNION ALL
    SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8
    FROM tops WHERE n > 1 GROUP BY level, pos // 8, n),
every_node AS (
    SELECT tree, level, pos, h FROM nodes WHERE n > 1 UNION ALL SELECT NULL, level, pos, h FROM tops WHERE n > 1),
runs AS (
    SELECT tree, level, pos,
           coalesce(string_agg(h, '') OVER (PARTITION BY tree, level, pos // 8 ORDER BY pos
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
           coalesce(string_agg(h, '') OVER (PARTITION BY tree, level, pos // 8 ORDER BY pos
                    ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM every_node),
up(id, tree, level, pos, h, proof) AS (
    SELECT id, tree, 0, pos, claim, '' FROM placed
    UNION ALL
    SELECT id, up.tree, level + 1, pos // 8, sha256(l || h || r), proof || l || r
    FROM up JOIN runs USING (tree, level, pos)),
at_sub AS (SELECT id, tree, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM up GROUP BY id, tree),
over(id, level, pos, h, proof) AS (
    SELECT id, 0, subs.pos, at_sub.h, proof FROM at_sub JOIN subs USING (tree)
    UNION ALL
    SELECT id, over.level + 1, over.pos // 8, sha256(l || h || r), proof || l || r
    FROM over JOIN runs ON runs.tree IS NULL AND runs.level = over.level AND runs.pos = over.pos),
done AS (SELECT id, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM over GROUP BY id)
SELECT doc_id, leaf, subs.h AS subroot, (SELECT h FROM tops WHERE n = 1) AS root, sha256(done.proof) AS proof_sha256,
       done.h AS folded_root, done.h = (SELECT h FROM tops WHERE n = 1) AS verified
FROM base JOIN subs USING (tree) JOIN done USING (id)""")
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof in the manifest, checked against texts of which a third changed."""
    docs = table(spark, sf_dir, "documents")
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    low = leaf_digest(*head, F.translate("text", UPPER, LOWER))
    leaves = docs.select("doc_id", "lang", leaf_digest(*head, F.col("text")).alias("leaf"),
                         F.when(remainder(3) == 0, low).alias("claim"))
    found = dataset_proofs(leaves, "lang", "doc_id", "leaf", keep=["claim"])
    checked = found.withColumn("folded_root", folded(F.coalesce("claim", "leaf"), F.col("proof")))
    return checked.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("proof")).alias("proof_sha256"),
                          "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@query("op11_hard_negatives", """
WITH r AS (
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.id AS anchor_id, a.label AS anchor_label, r.id, r.label, list_inner_product(a.v, r.v)::BIGINT AS score
    FROM r AS a JOIN r ON r.id <> a.id WHERE a.id % 100 = 0),
p AS (
    SELECT * FROM s WHERE label = anchor_label
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INTEGER AS rank,
       s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label
WHERE 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every hundredth vector and its five nearest of the same label, the ten hardest of other labels."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), label, F.col("id") % 100 == 0)


@query("op12_minhash_near_dedup", """
WITH w AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\\x20\\x09-\\x0D]+') AS ws FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM w),
g AS (
    SELECT doc_id, w || ' ' || lead(w, 1) OVER d || ' ' || lead(w, 2) OVER d || ' ' || lead(w, 3) OVER d || ' '
                   || lead(w, 4) OVER d AS g
    FROM u WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
e AS (
    SELECT doc_id, g FROM g WHERE g IS NOT NULL
    UNION SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM e GROUP BY doc_id),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
    JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
    WHERE 100 * least(na.n, nb.n) >= 85 * greatest(na.n, nb.n)
    GROUP BY a.doc_id, b.doc_id, na.n, nb.n
    HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
reach AS (
    WITH RECURSIVE r(doc_id, root) AS (
        SELECT doc_id, doc_id FROM documents
        UNION SELECT l.b, r.root FROM r JOIN links l ON l.a = r.doc_id)
    SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, reach.component_id, d.doc_id = reach.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id)""")
def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingles overlap by 85 % or more."""
    return sketch_components(table(spark, sf_dir, "documents"), n=5, percent=85)
