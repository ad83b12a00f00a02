"""The queries of this subpackage by name, and SQL for those it can express."""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corespar.tables import table

from .canonical import POSITIONS, RANKS, map_entries
from .clusters import similarity_clusters
from .copies import collapse
from .encode import encode_texts
from .mixing import mix_sources, mixture_shares
from .pii import find_personal, mask_personal, word_lists
from .quality import classify_texts, text_statistics
from .scans import repair_scans
from .similar import similar_pairs, similar_vectors

_SECRET = secrets.token_bytes(16)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark, folder):
    return similar_pairs(table(spark, folder, "document_elements"))


ORACLE["p1_found"] = """WITH u AS (SELECT element_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM document_elements
  WHERE len(embedding) = 96 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 96 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
c AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS s FROM u a, u b WHERE a.id <> b.id),
t AS (SELECT a, b FROM c WHERE s >= 0.5 QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 10 AND s >= 0.9)
SELECT DISTINCT least(a, b) AS element_id, greatest(a, b) AS neighbour_id FROM t"""


@query
def p1_neighbours(spark, folder):
    return similar_vectors(table(spark, folder, "document_elements")).withColumnRenamed("id", "element_id")


def _lists(spark, folder):
    return word_lists(table(spark, folder, "person_names"), [table(spark, folder, "lexicon").select("word"), table(spark, folder, "common_words").select("word")])


@query
def p10_found(spark, folder):
    return find_personal(table(spark, folder, "documents"), _lists(spark, folder)).select("doc_id", "pii_type", "start_pos")


@query
def p10_masked(spark, folder):
    """Keyed by spark.corespar.pseudonym.key; where that is unset by a key of the application, so values are linked within its results only."""
    key = spark.conf.get("spark.corespar.pseudonym.key", None) or hashlib.sha256(_SECRET + spark.sparkContext.applicationId.encode()).hexdigest()
    return mask_personal(table(spark, folder, "documents"), _lists(spark, folder), key)


@query
def p3_found(spark, folder):
    mapped = map_entries(table(spark, folder, "global_metadata"), table(spark, folder, "formation_reference"))
    return mapped.where("how != 'exact'").select("meta_id", "pos", "formation_id")


_RANK_SQL = "CASE " + " ".join(f"WHEN w IN ({', '.join(repr(x) for x in v.split())}) THEN '{k}'" for k, v in RANKS.items()) + " END"
_POSITION_SQL = "CASE " + " ".join(f"WHEN w IN ({', '.join(repr(x) for x in v.split())}) THEN '{k}'" for k, v in POSITIONS.items()) + " END"


def _parsed_sql(source: str) -> str:
    """(k, core, position, rank, code) of the values (k, v) of a table."""
    return f"""(SELECT k, translate(coalesce(string_agg(replace(w, '-', ''), '' ORDER BY i) FILTER (WHERE w <> '' AND {_RANK_SQL} IS NULL AND {_POSITION_SQL} IS NULL), ''), '01', 'ol') AS core,
  arg_min({_POSITION_SQL}, i) FILTER (WHERE {_POSITION_SQL} IS NOT NULL) AS position, arg_min({_RANK_SQL}, i) FILTER (WHERE {_RANK_SQL} IS NOT NULL) AS rank, any_value(code) AS code
  FROM (SELECT k, trim(unnest(t), '-') AS w, unnest(range(len(t))) AS i, regexp_replace(p, '[^a-z0-9]', '', 'g') AS code FROM
    (SELECT k, p, CASE WHEN len(regexp_extract_all(p, '[a-z0-9-]+')) = 0 THEN [''] ELSE regexp_extract_all(p, '[a-z0-9-]+') END AS t FROM
      (SELECT k, replace(regexp_replace(lower(strip_accents(v)), '\\([^)]*\\)', ' ', 'g'), '_', ' ') AS p FROM {source}))) GROUP BY k)"""


ORACLE["p3_found"] = f"""WITH rows AS (SELECT meta_id, CAST(unnest(range(len(formations))) AS INT) AS pos, unnest(formations) AS v FROM global_metadata),
todo AS (SELECT * FROM rows WHERE v IS NOT NULL AND regexp_matches(v, '\\S') AND v NOT IN (SELECT formation_name FROM formation_reference)),
vals AS (SELECT DISTINCT v AS k, v FROM todo), refs AS (SELECT formation_id AS k, formation_name AS v FROM formation_reference),
pv AS MATERIALIZED {_parsed_sql('vals')}, pr AS MATERIALIZED {_parsed_sql('refs')},
glued AS (SELECT k, regexp_replace(rtrim(k, ' .*?'), '[\\s_.]+(\\S+)$', '\\1') AS v FROM vals), pg AS MATERIALIZED {_parsed_sql('glued')},
codes AS (SELECT pv.k, min(formation_id) AS id FROM pv JOIN formation_reference f ON pv.code = regexp_replace(lower(f.code), '[^a-z0-9]', '', 'g') GROUP BY pv.k),
near AS (SELECT x.k, pr.k AS id, damerau_levenshtein(x.core, pr.core) AS d, coalesce(x.position = pr.position, false) AS p, coalesce(x.rank = pr.rank, false) AS r, x.g FROM
  (SELECT k, core, position, rank, 0 AS g FROM pv UNION ALL SELECT pg.k, pg.core, pv.position, pv.rank, 1 FROM pg JOIN pv USING (k) WHERE pv.rank IS NOT NULL) x JOIN pr ON x.core <> ''
  WHERE damerau_levenshtein(x.core, pr.core) <= CASE WHEN length(pr.core) < 5 THEN 0 WHEN length(pr.core) < 7 THEN 1 WHEN length(pr.core) = 7 THEN 2 ELSE 3 END),
best AS (SELECT * FROM near QUALIFY rank() OVER (PARTITION BY k ORDER BY g, d, p DESC, r DESC) = 1),
picked AS (SELECT k, CASE WHEN count(DISTINCT id) = 1 THEN min(id) ELSE 0 END AS id FROM best GROUP BY k)
SELECT meta_id, pos, CAST(coalesce(c.id, p.id, 0) AS INT) AS formation_id FROM todo LEFT JOIN codes c ON todo.v = c.k LEFT JOIN picked p ON todo.v = p.k"""


@query
def p3_unmatched(spark, folder):
    """Report of the values that mean no entry or more than one, with the number of places they stand in."""
    mapped = map_entries(table(spark, folder, "global_metadata"), table(spark, folder, "formation_reference"))
    return mapped.where("formation_id = 0").groupBy("entry", "how").count()


ORACLE["p3_unmatched"] = ORACLE["p3_found"][: ORACLE["p3_found"].index("SELECT meta_id, pos, CAST(coalesce")] + "SELECT v AS entry, CASE WHEN p.id IS NULL THEN 'none' ELSE 'ambiguous' END AS how, count(*) AS count FROM todo LEFT JOIN codes c ON todo.v = c.k LEFT JOIN picked p ON todo.v = p.k WHERE coalesce(c.id, p.id, 0) = 0 GROUP BY ALL"


@query
def p3_candidates(spark, folder):
    """All entries of the list within the limit of their length, for each value that is not exactly one of them."""
    mapped = map_entries(table(spark, folder, "global_metadata"), table(spark, folder, "formation_reference"))
    each = mapped.where("how != 'exact'").select("entry", F.explode("near").alias("n")).select("entry", "n.formation_id", "n.distance")
    return each.distinct()


ORACLE["p3_candidates"] = ORACLE["p3_found"][: ORACLE["p3_found"].index("SELECT meta_id, pos, CAST(coalesce")] + "SELECT k AS entry, id AS formation_id, CAST(min(d) AS INT) AS distance FROM (SELECT * FROM near QUALIFY g = min(g) OVER (PARTITION BY k)) GROUP BY k, id"


@query
def p8_ids(spark, folder):
    return encode_texts(table(spark, folder, "documents"))


@query
def p5_found(spark, folder):
    return collapse(table(spark, folder, "document_elements")).where("element_id != first_id").select("first_id", "element_id")


@query
def p5_copies(spark, folder):
    """Each set of same elements as one: its first element and its number of copies."""
    return collapse(table(spark, folder, "document_elements")).where("element_id = first_id").select("element_id", "copies")


SAME = r"""WITH e AS (
  SELECT element_id, lower(trim(regexp_replace(type, '^\s+|\s+$', '', 'g'))) AS kind, content FROM document_elements),
c AS (
  SELECT element_id, kind, regexp_replace(lower(content), '[^\p{L}\p{N}]', '', 'g') AS plain,
    CASE WHEN kind = 'table' THEN array_to_string(list_filter(list_transform(string_split(content, chr(10)), lambda l:
      array_to_string(list_sort(list_filter(list_transform(string_split_regex(l, '[|;\t]'), lambda f: regexp_replace(lower(f), '[^\p{L}\p{N}]', '', 'g')), lambda f: f <> '')), chr(31))), lambda l: l <> ''), chr(30))
    ELSE regexp_replace(lower(content), '[^\p{L}\p{N}]', '', 'g') END AS form FROM e),
s AS (
  SELECT element_id, min(element_id) OVER (PARTITION BY kind, form) AS first_id, count(*) OVER (PARTITION BY kind, form) AS copies
  FROM c WHERE length(plain) >= 40 AND kind IS NOT NULL)
"""
ORACLE["p5_found"] = SAME + "SELECT first_id, element_id FROM s WHERE element_id <> first_id"
ORACLE["p5_copies"] = SAME + "SELECT element_id, copies FROM s WHERE element_id = first_id"


def _clusters(spark, folder):
    return similarity_clusters(table(spark, folder, "document_elements"), table(spark, folder, "chunks"))


@query
def p6_found(spark, folder):
    return _clusters(spark, folder).select("record_kind", "record_id", "cluster_id")


ORACLE["p6_found"] = r"""WITH RECURSIVE u AS (SELECT element_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM document_elements
  WHERE len(embedding) = 96 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 96 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
w AS (SELECT chunk_id AS id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda x: x <> '')) AS s FROM chunks WHERE text IS NOT NULL),
big AS (SELECT id, len(s) AS n, unnest(s) AS t FROM w WHERE len(s) >= 30),
j AS (SELECT a.id AS a, b.id AS b FROM big a JOIN big b ON a.t = b.t AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n HAVING count(*) >= 0.5 * (a.n + b.n - count(*))),
e AS (SELECT 'element' AS kind, a.id AS a, b.id AS b FROM u a JOIN u b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.8 UNION ALL SELECT 'chunk', a, b FROM j),
nb AS (SELECT kind, a, b FROM e UNION SELECT kind, b, a FROM e),
r AS (SELECT kind, a AS id, a AS seen FROM nb UNION SELECT r.kind, r.id, nb.b FROM r JOIN nb ON r.kind = nb.kind AND r.seen = nb.a),
l AS (SELECT kind, id, min(seen) AS c, count(*) AS n FROM r GROUP BY kind, id)
SELECT kind AS record_kind, id AS record_id, c AS cluster_id FROM l WHERE n >= 5"""


@query
def p6_clusters(spark, folder):
    """Each group with its size and its most typical members."""
    best = _clusters(spark, folder).where("typical_rank is not null")
    return best.groupBy("record_kind", "cluster_id", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("typical_rank", "record_id"))), lambda x: x["record_id"]).alias("typical"))


def _scans(spark, folder):
    return repair_scans(table(spark, folder, "document_elements"), table(spark, folder, "lexicon"))


@query
def p4_found(spark, folder):
    return _scans(spark, folder).select("element_id", F.explode("noise_kinds").alias("noise_kind"))


@query
def p4_text(spark, folder):
    return _scans(spark, folder).select("element_id", "repaired")


def _classes(spark, folder):
    return classify_texts(*(table(spark, folder, t) for t in ("document_elements", "element_labels", "common_words", "lexicon")))


@query
def p7_found(spark, folder):
    return _classes(spark, folder).where("text_class != 'prose'").select("element_id", "text_class")


@query
def p7_shares(spark, folder):
    """Shares of line classes in each text element."""
    return _classes(spark, folder)


@query
def p7_statistics(spark, folder):
    return text_statistics(table(spark, folder, "document_elements"), table(spark, folder, "common_words"))


ORACLE["p7_statistics"] = r"""WITH t AS (
  SELECT element_id, content FROM document_elements
  WHERE lower(regexp_replace(type, '^\s+|\s+$', '', 'g')) = 'text' AND length(regexp_replace(content, '^\s+|\s+$', '', 'g')) >= 4),
s AS (
  SELECT element_id, content, regexp_extract_all(lower(content), '\p{L}+') AS words,
    list_filter(string_split(content, chr(10)), lambda x: length(trim(regexp_replace(x, '\s+', ' ', 'g'))) > 0) AS lines,
    (SELECT list(DISTINCT lower(word)) FROM common_words) AS common FROM t)
SELECT element_id, len(words) AS n_words,
  CASE WHEN len(words) > 0 THEN round(length(array_to_string(words, '')) / len(words), 6) ELSE 0.0 END AS mean_word_length,
  round(length(regexp_replace(content, '[\p{L}\p{N}\s]', '', 'g')) / length(content), 6) AS symbol_ratio,
  CASE WHEN len(lines) > 0 THEN round(len(list_filter(lines, lambda x: regexp_matches(regexp_replace(x, '\s+$', ''), '[.!?;:,]$'))) / len(lines), 6) ELSE 0.0 END AS share_punctuated,
  CASE WHEN len(words) > 0 THEN round(len(list_filter(words, lambda x: list_contains(common, x))) / len(words), 6) ELSE 0.0 END AS share_common
FROM s"""


@query
def p8_token_counts(spark, folder):
    """Tokens of each document, without its list of ids."""
    return encode_texts(table(spark, folder, "documents"), count_only=True)


@query
def p9_mix(spark, folder):
    return mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


@query
def p9_shares(spark, folder):
    targets = table(spark, folder, "mix_targets")
    return mixture_shares(mix_sources(table(spark, folder, "documents"), targets), targets)


def _by_characters(spark, folder):
    return table(spark, folder, "documents").withColumn("size", F.length("text"))


@query
def p9_characters(spark, folder):
    """The selection with characters as sizes."""
    return mix_sources(_by_characters(spark, folder), table(spark, folder, "mix_targets"), size_col="size").select("doc_id", "source", "use_no", F.col("n_tokens").alias("size"))


@query
def p9_total(spark, folder):
    """Shares really reached when a total is given, as many characters as the listed sources have: sources that max_repeats leaves short are seen."""
    docs, targets = _by_characters(spark, folder), table(spark, folder, "mix_targets")
    total = docs.join(targets.select("source").distinct(), "source", "left_semi").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shares = mixture_shares(mix_sources(docs, targets, total_tokens=total, size_col="size"), targets)
    return shares.select("source", F.round("target_share", 6).alias("target_share"), "max_repeats", F.col("tokens").alias("size"), "records", "most_uses", F.round("actual_share", 6).alias("actual_share"))


def _mix_sql(total: str) -> str:
    return f"""WITH t AS (SELECT source, sum(target_share) AS w, max(max_repeats) AS r FROM mix_targets GROUP BY source),
d AS (SELECT doc_id, source, length(text) AS n, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT AS h FROM documents SEMI JOIN t USING (source) WHERE length(text) > 0),
a AS (SELECT source, sum(n)::BIGINT AS a FROM d GROUP BY source), g AS (SELECT source, a, r, w / sum(w) OVER () AS w FROM a JOIN t USING (source)),
q AS (SELECT source, a, r, CAST(floor(least(({total}) * w, a * r) + 1e-6) AS BIGINT) AS quota FROM g),
p AS (SELECT d.*, a, r, quota, sum(n) OVER (PARTITION BY source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - n AS start FROM d JOIN q USING (source)),
u AS (SELECT doc_id, source, n, CAST(least(floor((quota - start - n / 2) / a) + 1, r) AS INT) AS uses FROM p WHERE quota - start - n / 2 >= 0)
"""


ORACLE["p9_characters"] = _mix_sql("SELECT min(a * r / w) FROM g") + "SELECT doc_id, source, CAST(unnest(range(uses)) AS INT) AS use_no, n AS size FROM u"
ORACLE["p9_total"] = _mix_sql("SELECT sum(a) FROM a") + """, s AS (SELECT source, sum(n * uses)::BIGINT AS size, count(*) AS records, max(uses) AS most_uses FROM u GROUP BY source)
SELECT source, round(w, 6) AS target_share, r AS max_repeats, coalesce(size, 0) AS size, coalesce(records, 0) AS records, coalesce(most_uses, 0) AS most_uses, round(coalesce(size, 0) / sum(coalesce(size, 0)) OVER (), 6) AS actual_share FROM t LEFT JOIN s USING (source)"""
