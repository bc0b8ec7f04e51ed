"""The queries of this subpackage, by name: each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import embedding_duplicates, mixing, near_duplicates, neighbours, packing, personal_data, quality, repeated_passages, secrets, toxicity


def _table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_neighbours(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows.where("vec_id % 20 = 0"))


def op2_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_secrets(spark, sf_dir):
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    return secrets.span_digests(found, "secrets", secrets.KINDS)


def op6_repeated_passages(spark, sf_dir):
    return repeated_passages.remove_repeats(_table(spark, sf_dir, "documents"))


def op7_quality(spark, sf_dir):
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_embedding_duplicates(spark, sf_dir):
    return embedding_duplicates.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


#: Target weights: by group of sources, and by language within it; sources of a language weigh alike.
GROUPS = {"group0": 4.0, "group1": 3.0, "group2": 2.0, "group3": 1.0}
LANGUAGES = {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}
WEIGHTS = {(g,): w for g, w in GROUPS.items()} | {(g, x): w for g in GROUPS for x, w in LANGUAGES.items()}


def levels() -> dict:
    """The tree of the table ``documents``: a group by the source's number, its language, the source."""
    number = F.coalesce(F.regexp_extract("source", "([0-9]+)$", 1).try_cast("long"), F.lit(0))
    return {"domain": F.concat(F.lit("group"), number % 4), "lang": F.col("lang"), "source": F.col("source")}


def op9_mixing(spark, sf_dir):
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"), levels(), WEIGHTS, budget=1.0, seed=9, epochs=2)
    return mixed.select("doc_id", "_mix.epoch", "_mix.tokens", "_mix.domain", "_mix.lang", "_mix.source")


def op10_personal_data(spark, sf_dir):
    found = personal_data.find_personal_data(_table(spark, sf_dir, "documents"))
    return secrets.span_digests(found, "found", personal_data.KINDS)


def op4_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark, sf_dir):
    return near_duplicates.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_neighbours, op2_toxicity, op3_secrets, op4_packing, op5_near_duplicates, op6_repeated_passages, op7_quality, op8_embedding_duplicates, op9_mixing, op10_personal_data)}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: By brute force. The others have none: SQL can't express trained models, taggers, tokens, trees or searches.
ORACLES: dict[str, str] = {
    "op5_near_duplicates": f"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'{_UPPER}','{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
cut AS (SELECT doc_id, w, unnest(CASE WHEN len(w)=0 THEN [] ELSE range(1, greatest(len(w)-4,1)+1) END) AS i FROM words),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4],' ') AS s FROM cut),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s=b.s AND a.doc_id<>b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id=a JOIN sizes y ON y.doc_id=b WHERE 100*shared >= 75*(x.n+y.n-shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b=l.a),
roots AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT r.doc_id, coalesce(n,0) AS n_shingles, component_id, r.doc_id=component_id AS kept FROM roots r LEFT JOIN sizes s ON s.doc_id=r.doc_id""",
    "op6_repeated_passages": """WITH hexed AS (SELECT doc_id, hex(encode(coalesce(text,''))) AS h FROM documents),
places AS (SELECT doc_id, h, unnest(range(0, length(h)//2)) AS p FROM hexed),
bytes AS (SELECT doc_id, p, substring(h, 2*p+1, 2) AS c, CASE WHEN 2*p+200 <= length(h) THEN md5(substring(h, 2*p+1, 200)) END AS w FROM places),
ranked AS (SELECT doc_id, p, c, w IS NOT NULL AND row_number() OVER (PARTITION BY w ORDER BY doc_id, p) > 1 AS dup FROM bytes),
covered AS (SELECT doc_id, p, c, coalesce(max(CASE WHEN dup THEN p END) OVER (PARTITION BY doc_id ORDER BY p) > p-100, false) AS gone FROM ranked),
marked AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM covered),
done AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans,
  coalesce(string_agg(c, '' ORDER BY p) FILTER (WHERE NOT gone), '') AS kept FROM marked GROUP BY doc_id)
SELECT h.doc_id, coalesce(n_bytes,0) AS n_bytes, coalesce(n_removed,0) AS n_removed, coalesce(n_spans,0) AS n_spans, sha256(unhex(coalesce(kept,''))) AS kept_sha256
FROM hexed h LEFT JOIN done d ON d.doc_id=h.doc_id""",
    "op8_embedding_duplicates": """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id<>b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b=l.a),
roots AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT r.vec_id, coalesce(n,0) AS n_links, component_id, r.vec_id=component_id AS kept FROM roots r LEFT JOIN n ON n.a=r.vec_id""",
}
