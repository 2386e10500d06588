"""The registered queries of the training-data operators, each over its whole table, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import exact_groups
from .languages import fit, identify_documents, identify_pages
from .licences import BLOCK_WORDS, PHRASES, TEMPLATES, THRESHOLD, pieces, scan_licences
from .manifest import COLUMNS, folded, leaf_digest, lower_ascii, manifest, proof
from .mixing import mix
from .packing import pack_documents
from .phrases import LEAST, MOST_WORDS, TOP, UNKNOWN, collocations
from .secrets import BASE_KINDS, OPAQUE, WIDE_OWNERS, WIDE_REPOSITORIES, scan_secrets
from .simhash import near_groups
from .substrings import remove_repeats
from .toxicity import fit as fit_toxicity
from .toxicity import score as score_toxicity
from .vectors import top_k
from .web_archive import convert_pages

#: The tokenizer file's name within the installed vocabulary package.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(_table(spark, sf_dir, "documents")).drop("blocks")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_live", "n_example", "most_owners", "most_repositories")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with all their evidence, and documents, whose source stands for the host; the model comes from documents."""
    docs = _table(spark, sf_dir, "documents")
    model = fit(docs)
    pages = identify_pages(_table(spark, sf_dir, "pages"), model)
    return identify_documents(docs, model).unionByName(pages, allowMissingColumns=True)


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert_pages(_table(spark, sf_dir, "pages"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, _table(spark, sf_dir, "labels"))).drop("features")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third row by the checksum of its id is judged with its text in lower case, as if someone had changed it."""
    docs = _table(spark, sf_dir, "documents")
    struck = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    changed = [F.when(struck, lower_ascii(F.col(c))).otherwise(F.col(c)) if c == "text" else F.col(c) for c in COLUMNS]
    found = manifest(docs, also={"seen": leaf_digest(*changed)}).withColumn("folded_root", folded(F.col("seen"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_substring_dedup, op2_exact_top_k, op3_license_scan, op4_best_fit_packing, op5_secret_scan, op6_exact_dedup, op7_language_id, op8_source_mix, op9_arc_to_warc, op10_simhash_dedup, op11_toxicity, op12_phrase_collocations, op13_merkle_manifest)
    return {f.__name__: f for f in found}


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
windows AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
least AS (SELECT s, min(doc_id) AS m FROM windows GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN least USING (s) WHERE m < doc_id),
marked AS (SELECT w.doc_id, w.word, w.p, g.p IS NOT NULL AS removed FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.p = g.p),
kept AS (SELECT doc_id, count(*) FILTER (removed) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT removed) AS t FROM marked GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

OP2_SQL = r"""
WITH finite AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM finite),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""



def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _licence_sql() -> str:
    """Phrases at every word, and every block against every template: what the join finds without its filters."""
    at = lambda phrase: " AND ".join(f"w[i + {k}] = {_quoted(x)}" for k, x in enumerate(phrase.split()))
    places = " UNION ALL ".join(f"SELECT doc_id, unnest(list_filter(range(1, len(w) + 1), lambda i: {at(k)})) - 1 AS at_word, {_quoted(v)} AS label FROM d" for k, v in PHRASES.items())
    listed = lambda values: f"[{', '.join(_quoted(x) for x in sorted(values))}]::VARCHAR[]"
    sets = ", ".join(f"({i}, {_quoted(p.label)}, {listed(p.tokens)}, {listed(p.needed)}, {sorted(p.within)}::INTEGER[])" for i, p in enumerate(pieces(TEMPLATES, THRESHOLD)))
    half = BLOCK_WORDS // 2
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS ({places}),
base AS (SELECT doc_id, count(*) AS n_base, min(at_word) AS first_word, max(at_word) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY doc_id),
templates(piece, label, tokens, needed, within) AS (VALUES {sets}),
blocks AS (SELECT doc_id, b, list_slice(w, b * {half} + 1, b * {half} + {BLOCK_WORDS}) AS held FROM (SELECT doc_id, w, unnest(range(0, (len(w) + {half - 1}) // {half})) AS b FROM d)),
shared AS (SELECT doc_id, b, piece, label, within, len(list_filter(tokens, lambda x: list_contains(held, x))) / len(tokens) AS share, list_has_all(held, needed) AS told FROM blocks, templates),
matched AS (SELECT * FROM shared WHERE share >= {THRESHOLD} - 1e-9 AND told),
found AS (SELECT doc_id, max(share) AS best, list(DISTINCT label) AS labels FROM matched m WHERE NOT EXISTS (SELECT 1 FROM matched o WHERE o.doc_id = m.doc_id AND o.b = m.b AND list_contains(m.within, o.piece)) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ',') AS labels, coalesce(best, 0.0) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def _secret_sql() -> str:
    kinds = [*enumerate(BASE_KINDS), (len(BASE_KINDS), OPAQUE)]
    cut = ", ".join(f"SELECT {r} AS rank, {_quoted(k)} AS kind, {n} AS least, doc_id, owner, repository, regexp_extract_all(t, {_quoted(p)}) AS m, regexp_extract_all(t, {_quoted(p)}, {g}) AS v, regexp_split_to_array(t, {_quoted(p)}) AS g FROM d" for r, (k, p, g, n) in kinds).replace(", SELECT", " UNION ALL SELECT")
    listed = lambda rows: f"coalesce(string_agg(concat(kind, ':', CAST(start_at AS VARCHAR), ':', CAST(end_at AS VARCHAR)), ',' ORDER BY start_at, rank) FILTER ({rows}), '')"
    counts = ", ".join(f"count(*) FILTER (kind = {_quoted(k[0])}) AS n_{k[0]}" for k in BASE_KINDS)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repository, coalesce(text, '') AS t FROM documents),
cut AS ({cut}),
each AS (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM cut),
spans AS (
  SELECT rank, kind, doc_id, owner, repository, v[k] AS value, CAST(list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS start_at, length(m[k]) AS size
  FROM each WHERE length(v[k]) >= least),
placed AS (SELECT *, start_at + size AS end_at FROM spans),
candidates AS (
  SELECT * FROM placed p WHERE kind <> '{OPAQUE[0]}' OR (regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[0-9]')
    AND NOT EXISTS (SELECT 1 FROM placed b WHERE b.doc_id = p.doc_id AND b.kind <> '{OPAQUE[0]}' AND b.start_at < p.end_at AND p.start_at < b.end_at))),
owned AS (SELECT value, count(DISTINCT owner) AS n_owners, count(DISTINCT (owner, repository)) AS n_repositories FROM candidates GROUP BY value),
judged AS (SELECT *, n_owners < {WIDE_OWNERS} AND n_repositories < {WIDE_REPOSITORIES} AS live FROM candidates JOIN owned USING (value)),
reported AS (SELECT * FROM judged WHERE kind <> '{OPAQUE[0]}' OR live),
summed AS (SELECT doc_id, {counts}, {listed(f"kind <> '{OPAQUE[0]}'")} AS base, {listed('true')} AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example, max(n_owners) AS most_owners, max(n_repositories) AS most_repositories FROM reported GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{k[0]}, 0) AS n_{k[0]}' for k in BASE_KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(most_owners, 0) AS most_owners, coalesce(most_repositories, 0) AS most_repositories
FROM d LEFT JOIN summed USING (doc_id)
"""


OP6_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""

OP9_SQL = r"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, CAST(unhex(sha1(coalesce(html, ''))) AS BIT) AS bits FROM pages),
coded AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: get_bit(bits, CAST(5 * k + j AS INTEGER)) * (1 << (4 - j))))::INTEGER, 1)), '') AS payload_digest FROM p),
kept AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS winner FROM coded)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> winner THEN winner END AS refers_to FROM kept
"""

OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM sources),
levels AS (
  SELECT *, CAST(cap AS DOUBLE) / weight AS ratio, row_number() OVER below_all AS rn,
    CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER below, 0) AS DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER below, 0)) AS lev
  FROM weighed WINDOW below AS (ORDER BY CAST(cap AS DOUBLE) / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    below_all AS (ORDER BY CAST(cap AS DOUBLE) / weight, source)),
targets AS (
  SELECT source, source_size, CASE WHEN ratio < l.level THEN CAST(cap AS DOUBLE) ELSE weight * l.level END AS target
  FROM levels, (SELECT arg_min(lev, rn) FILTER (ratio >= lev) AS level FROM levels) l),
plan AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget,
    CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS epochs FROM targets),
placed AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.budget, p.epochs,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(concat('mix:', p.epochs, ':', coalesce(CAST(d.doc_id AS VARCHAR), 'null'))), d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM placed
"""

_GRAMS = " UNION ALL ".join(f"SELECT lang, {k} AS k, array_to_string(list_slice(w, i, i + {k - 1}), ' ') AS p FROM (SELECT lang, w, unnest(range(1, len(w) + 1 - {k - 1})) AS i FROM pieces)" for k in range(1, MOST_WORDS + 1))
OP12_SQL = rf"""
WITH cut AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM cut),
totals AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
counts AS (SELECT lang, k, p, count(*) AS a FROM ({_GRAMS}) GROUP BY lang, k, p HAVING count(*) >= {LEAST}),
inside AS (SELECT DISTINCT s.lang, s.p FROM counts s JOIN counts q ON s.lang = q.lang AND q.k > s.k AND q.a >= s.a AND contains(concat(' ', q.p, ' '), concat(' ', s.p, ' '))),
cuts AS (SELECT lang, p, a, k, string_split(p, ' ') AS w, unnest(range(1, k)) AS c FROM counts WHERE k > 1 AND (lang, p) NOT IN (SELECT (lang, p) FROM inside)),
parts AS (SELECT lang, p, a, c, array_to_string(w[1:c], ' ') AS x, array_to_string(w[c + 1:k], ' ') AS y FROM cuts),
scored AS (SELECT q.lang, q.p, q.a, c, l.a AS l, r.a AS r, n, CAST(CAST(1000 AS HUGEINT) * q.a * n // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
  FROM parts q JOIN counts l ON q.lang = l.lang AND q.x = l.p JOIN counts r ON q.lang = r.lang AND q.y = r.p JOIN totals t ON q.lang = t.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, c) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM lowest QUALIFY rank <= {TOP}
"""

#: DuckDB has no crc32: its table comes from the polynomial. Runs of both trees, the top one named apart, are a row's path.
OP13_SQL = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
texts AS (SELECT doc_id, lang, CAST(doc_id AS VARCHAR) AS id, source, CAST(n_chars AS VARCHAR) AS n, text,
  xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) AS crc FROM documents, crc),
seen AS (SELECT *, CASE WHEN crc % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS text2 FROM texts),
told AS (SELECT doc_id, lang, concat(coalesce(strlen(id) || ':' || id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n) || ':' || n, '-')) AS head, text, text2 FROM seen),
hashed AS (SELECT doc_id, coalesce('=' || lang, '') AS g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(text2) || ':' || text2, '-')) AS seen FROM told),
leaves AS (SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM hashed),
nodes AS (SELECT 0 AS k, g, i, n, leaf AS h FROM leaves UNION ALL SELECT k + 1, g, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY k, g, i // 8, (n + 7) // 8),
subroots AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
highs AS (SELECT 0 AS k, i, n, h FROM subroots UNION ALL SELECT k + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM highs WHERE n > 1 GROUP BY k, i // 8, (n + 7) // 8),
runs AS (SELECT k, g, i // 8 AS p, list(h ORDER BY i) AS run FROM nodes WHERE n > 1 GROUP BY k, g, i // 8),
high_runs AS (SELECT k, i // 8 AS p, list(h ORDER BY i) AS run FROM highs WHERE n > 1 GROUP BY k, i // 8),
steps AS (
  SELECT rid, 0 AS tree, k, (i >> (3 * k)) % 8 AS place, run FROM leaves l JOIN runs r ON l.g = r.g AND l.i >> (3 * k + 3) = r.p
  UNION ALL SELECT rid, 1, k, (s.i >> (3 * k)) % 8, run FROM leaves l JOIN subroots s ON l.g = s.g JOIN high_runs r ON s.i >> (3 * k + 3) = r.p),
paths AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY tree, k) - 1 AS step FROM steps),
proofs AS (SELECT rid, string_agg(array_to_string(run[1:place], '') || array_to_string(run[place + 2:8], ''), '' ORDER BY step) AS siblings, count(*) AS depth FROM paths GROUP BY rid),
folds AS (SELECT rid, CAST(0 AS BIGINT) AS step, seen AS h FROM leaves UNION ALL
  SELECT f.rid, f.step + 1, sha256(concat(array_to_string(run[1:place], ''), h, array_to_string(run[place + 2:8], ''))) FROM folds f JOIN paths p ON f.rid = p.rid AND f.step = p.step)
SELECT doc_id, leaf, s.h AS subroot, r.h AS root, sha256(coalesce(siblings, '')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM leaves l JOIN subroots s USING (g) JOIN highs r ON r.n = 1 LEFT JOIN proofs p ON l.rid = p.rid JOIN folds f ON f.rid = l.rid AND f.step = coalesce(depth, 0)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op2_exact_top_k": OP2_SQL, "op3_license_scan": _licence_sql(), "op5_secret_scan": _secret_sql(), "op6_exact_dedup": OP6_SQL, "op8_source_mix": OP8_SQL, "op9_arc_to_warc": OP9_SQL, "op12_phrase_collocations": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
