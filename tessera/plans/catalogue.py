"""Registered queries of the retrieval library and their SQL.

The given tables stand in for a guide: documents are its pages (page number doc_id % 168 + 1), benchmark items and the
vectors whose id is divisible by 50 are questions, an embedding's label is its section, user turns are requests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import scores, text
from tessera.operators import conversations, encoder, evaluation, fragments, gate, pages, pair_index, retrieval, stages, vector_index
from tessera.session import materialized, shared_path, table
from tessera.sources import corpus
from tessera.streaming import answers, page_index, patches

EVERY = 50
TAG = config.DEFAULT.tag
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)


# --- SQL pieces ------------------------------------------------------------------------------------------------------


def _values(rows, names: str) -> str:
    def lit(x):
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({names}))"


def _starts(rows, name: str) -> str:
    ends = [p for p, _ in rows[1:]] + [1 << 30]
    return _values([(p, e, n) for (p, n), e in zip(rows, ends)], f"lo, hi, {name}")


def _words(expr: str) -> str:
    return f"CAST(len(list_filter(regexp_split_to_array(coalesce({expr}, ''), '\\s+'), lambda x: x <> '')) AS BIGINT)"


ALLOWED = " OR ".join(f"(page >= {lo} AND page < {hi})" for lo, hi in config.ALLOWED_PAGES)
P = "p AS (SELECT doc_id, CAST(doc_id % 168 + 1 AS INTEGER) AS page, text FROM documents)"
LOCATED = f"""located AS (
  SELECT p.doc_id, p.page, p.text, s.seccion,
    CASE WHEN p.page >= 54 AND p.page < 158 THEN coalesce(a.act, '') ELSE '' END AS actividad,
    CASE WHEN p.page >= 54 AND p.page < 158 AND t.lo >= a.lo THEN t.tool ELSE '' END AS herramienta
  FROM p
  LEFT JOIN {_starts(config.SECTIONS, "seccion")} s ON p.page >= s.lo AND p.page < s.hi
  LEFT JOIN {_starts(config.ACTIVITIES, "act")} a ON p.page >= a.lo AND p.page < a.hi
  LEFT JOIN {_starts(config.TOOLS, "tool")} t ON p.page >= t.lo AND p.page < t.hi)"""
STAGED = f"{LOCATED}, staged AS (SELECT l.*, e.etapa FROM located l LEFT JOIN {_values(config.STAGES, 'etapa, name')} e ON e.name = l.actividad)"
LABEL = "concat_ws(' › ', CASE WHEN actividad = '' THEN seccion END, nullif(actividad, ''), nullif(herramienta, '')) || ', p. ' || page"
OVER = f"""p AS (SELECT doc_id, page, CASE WHEN page = 2 THEN '{config.OVERRIDES[0][1]}' ELSE text END AS text
  FROM (SELECT doc_id, CAST(doc_id % 168 + 1 AS INTEGER) AS page, text FROM documents) WHERE {ALLOWED})"""
BUILT = f"""{OVER}, {STAGED}, built AS (SELECT printf('guia-p%03d', page) AS id, doc_id, text, {LABEL} AS fuente, page AS pagina_inicio,
  page AS pagina_fin, seccion, actividad, herramienta, CAST(etapa AS INTEGER) AS etapa, 'v2' AS version_corpus FROM staged WHERE {_words("text")} >= 15)"""
BLOCKS = """blocks AS (SELECT doc_id, pos, CASE WHEN pos % 7 = 6 THEN 'footer' WHEN pos % 5 = 2 THEN 'picture' ELSE 'text' END AS kind, text
  FROM (SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"""
FIGURES = f"""joined AS (SELECT doc_id, pos AS fig_id, trim(regexp_replace(array_to_string(list_filter(string_split(text, ', '), lambda x: trim(x, ' ') <> ''), ' '), '\\s+', ' ', 'g'), ' ') AS t
  FROM blocks WHERE kind = 'picture'), figures AS (SELECT doc_id, fig_id, CASE WHEN {_words("t")} >= 3 THEN '[Figura] ' || t ELSE '' END AS text FROM joined)"""
#: Greedy sentence packing as a recursion over fragments; pl holds the prefix sums of a document's sentence lengths.
CHUNKS = """sent AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '\\S')) AS l FROM documents),
  lens AS (SELECT doc_id, l, list_transform(l, lambda s: len(list_filter(regexp_split_to_array(s, '\\s+'), lambda x: x <> ''))) AS w FROM sent WHERE len(l) > 0),
  sums AS (SELECT doc_id, l, w, list_prepend(0, list_transform(range(1, len(w) + 1), lambda i: list_sum(w[1:i]))) AS pl, len(w) AS n FROM lens),
  chunk(doc_id, pos, s, e) AS (
    SELECT doc_id, 0, 1, CAST(greatest(1, len(list_filter(pl, lambda x: x <= {size})) - 1) AS BIGINT) FROM sums
    UNION ALL
    SELECT doc_id, pos + 1, s2, greatest(s2, len(list_filter(pl, lambda x: x <= pl[s2] + {size})) - 1) FROM (
      SELECT c.doc_id, c.pos, u.pl, CAST(least(c.e + 1, greatest(c.s + 1, len(list_filter(u.pl, lambda x: x < greatest(u.pl[c.e + 1] - {overlap}, u.pl[c.e + 2] - {size}))) + 1)) AS BIGINT) AS s2
      FROM chunk c JOIN sums u USING (doc_id) WHERE c.e < u.n)),
  chunks AS (SELECT c.doc_id, CAST(c.pos AS BIGINT) AS pos, CAST(c.s AS BIGINT) AS first, CAST(c.e AS BIGINT) AS last,
    CAST(u.pl[c.e + 1] - u.pl[c.s] AS BIGINT) AS n_words, array_to_string(u.l[c.s:c.e], ' ') AS text FROM chunk c JOIN sums u USING (doc_id))"""


def _chunks(size=400, overlap=50) -> str:
    return CHUNKS.replace("{size}", str(size)).replace("{overlap}", str(overlap))


COSINE = "round(list_dot_product(q.v, f.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(f.v, f.v)), 6)"
VECTORS = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def _knn(k: int, name: str = "knn", where: str = "TRUE") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT q.vec_id AS qid, f.vec_id AS fid, {COSINE} AS score, q.label AS qlabel, f.label AS flabel,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY {COSINE} DESC, f.vec_id) AS rank
      FROM e q JOIN e f ON q.vec_id <> f.vec_id AND {where} WHERE q.vec_id % {EVERY} = 0) WHERE rank <= {k})"""


PAIRS = """dw AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM documents),
  qw AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM benchmark),
  db AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS pair FROM dw WHERE len(t) > 1),
  qb AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS pair FROM qw WHERE len(t) > 1),
  dn AS (SELECT id, count(*) AS n FROM db GROUP BY id), qn AS (SELECT id, count(*) AS n FROM qb GROUP BY id),
  sh AS (SELECT qb.id AS qid, db.id AS fid, count(*) AS shared FROM qb JOIN db USING (pair) GROUP BY ALL),
  cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, fid) AS rank FROM (
    SELECT qid, fid, round(shared / sqrt(qn.n * dn.n), 6) AS score, round(shared / qn.n, 6) AS pair_score
    FROM sh JOIN qn ON qn.id = qid JOIN dn ON dn.id = fid)) WHERE rank <= 20),
  hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pair_score DESC, rank) AS final_rank FROM cand) WHERE final_rank <= 4),
  held AS (SELECT b.item_id AS qid, d.doc_id AS fid FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> ''),
  top AS (SELECT h.qid, h.fid, h.final_rank AS rank, h.pair_score AS score, x.fid IS NOT NULL AS hit FROM hits h LEFT JOIN held x USING (qid, fid)),
  quest AS (SELECT item_id AS qid, CASE WHEN item_id IN (SELECT qid FROM held) THEN 'respondible' ELSE 'fuera' END AS category FROM benchmark),
  per AS (SELECT qid, CAST(printf('%.4f', max(score)) AS DOUBLE) AS best, min(CASE WHEN hit THEN rank END) AS hit_rank, CAST(printf('%.4f', min_by(score, CASE WHEN hit THEN rank END)) AS DOUBLE) AS hit_score,
    string_agg(printf('%.4f', score), ',' ORDER BY rank) AS scores FROM top GROUP BY qid),
  st AS (SELECT q.qid, q.category, coalesce(p.best, 0.0) AS best, p.hit_rank, p.hit_score, p.scores FROM quest q LEFT JOIN per p USING (qid))"""


def _pct(part: str, total: str) -> str:
    return f"CASE WHEN {total} = 0 THEN 0.0 ELSE round(100.0 * {part} / {total}, 1) END"


SWEEP = f"""sweep AS (SELECT umbral,
    CAST({_pct("count_if(category = 'fuera' AND best < umbral)", "count_if(category = 'fuera')")} AS DOUBLE) AS rechazo_fuera,
    CAST({_pct("count_if(category = 'respondible' AND best < umbral)", "count_if(category = 'respondible')")} AS DOUBLE) AS falsos_no_encuentro,
    CAST({_pct("count_if(category = 'respondible' AND coalesce(hit_score >= umbral, FALSE))", "count_if(category = 'respondible')")} AS DOUBLE) AS recall,
    CAST(0 AS BIGINT) AS ambiguas_rechazadas
  FROM st, {_values([(t,) for t in config.THRESHOLDS], "u")} g(umbral) GROUP BY umbral)"""


# --- frames ----------------------------------------------------------------------------------------------------------


def _pages(spark, d):
    return pages.pages_of(table(spark, d, "documents"))


def _built(spark, d):
    return pages.build_pages(_pages(spark, d))


def _questions(spark, d):
    e = table(spark, d, "embeddings")
    return e.filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"), F.col("label").alias("qlabel"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("fid"), F.col("embedding").alias("fv"), F.col("label").alias("flabel"))


def _rankings(spark, d, k):
    """The vectors' ranking with the question's and the fragment's label."""
    hits = retrieval.nearest(_questions(spark, d), _vectors(spark, d), k)
    return hits.join(_questions(spark, d).select("qid", "qlabel"), "qid").join(_vectors(spark, d).select("fid", "flabel"), "fid")


def _candidates(spark, d, index=None):
    return retrieval.lexical(table(spark, d, "benchmark"), table(spark, d, "documents"), config.DEFAULT.candidates, index=index)


def _index(spark, d):
    return retrieval.indexed(table(spark, d, "benchmark"), table(spark, d, "documents"))


def _held(spark, d, index):
    """(qid, fid, hit) of every document that contains an item, found by retrieval or not."""
    held = retrieval.holders(table(spark, d, "benchmark"), table(spark, d, "documents"), index=index)
    return materialized(held.withColumn("hit", F.lit(True)), "held")


def _hits(spark, d, index=None):
    """(qid, fid, rank, score) of the reranked candidates."""
    top = retrieval.reranked(_candidates(spark, d, index), config.DEFAULT.top_k)
    return top.select("qid", "fid", F.col("final_rank").alias("rank"), F.col("pair_score").alias("score"))


def _top(spark, d):
    """(qid, fid, rank, score, hit) of the reranked candidates and the questions with their category."""
    items, index = table(spark, d, "benchmark").select(F.col("item_id").alias("qid")), _index(spark, d)
    held = _held(spark, d, index)
    top = _hits(spark, d, index).join(held, ["qid", "fid"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    known = held.select("qid").distinct().withColumn("known", F.lit(True))
    quest = items.select("qid").join(known, "qid", "left").select("qid", F.when(F.col("known"), "respondible").otherwise("fuera").alias("category"))
    return materialized(top, "top"), quest


def _scores(spark, d):
    return evaluation.score_table(*_top(spark, d))


def _cited(spark, d):
    """Reranked hits above the threshold with their page's metadata."""
    top = _hits(spark, d)
    meta = pages.located(_pages(spark, d)).withColumn("fuente", pages.label())
    meta = meta.select(F.col("doc_id").alias("fid"), "text", "fuente", F.col("page").alias("pagina_inicio"), "seccion", "actividad", "herramienta")
    return gate.above(top).join(meta, "fid")


def _asked(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"), (F.col("item_id") % 9).cast("int").alias("stage"))


# --- sources ---------------------------------------------------------------------------------------------------------


@register(f"WITH {BUILT} SELECT id, md5(text) AS texto_md5, fuente, pagina_inicio, coalesce(etapa, 0) AS etapa, '{TAG}' AS indice FROM built")
def load_pages(spark, d):
    path = shared_path(spark, "pages")
    corpus.write_pages(_built(spark, d).drop("doc_id").withColumnRenamed("text", "texto"), path)
    return corpus.read_pages(spark, path, TAG).select("id", F.md5("texto").alias("texto_md5"), "fuente", "pagina_inicio", "etapa", "indice")


@register()
def write_pages(spark, d):
    path = shared_path(spark, "pages")
    corpus.write_pages(_built(spark, d).drop("doc_id").withColumnRenamed("text", "texto"), path)
    return spark.read.text(path).groupBy(F.lit("v2").alias("version_corpus")).agg(F.count("*").alias("records"))


@register("SELECT 'Q-' || item_id AS id, md5(text) AS pregunta_md5, 'Section ' || (item_id % 5) AS seccion_fuente FROM benchmark WHERE item_id % 5 <> 0 AND text IS NOT NULL")
def load_questions(spark, d):
    items = table(spark, d, "benchmark")
    section = F.when(F.col("item_id") % 5 != 0, F.concat(F.lit("Section "), (F.col("item_id") % 5).cast("string"))).otherwise("")
    path = shared_path(spark, "questions")
    items.select(F.concat(F.lit("Q-"), F.col("item_id").cast("string")).alias("id"), F.col("text").alias("pregunta"), section.alias("seccion_fuente")).write.json(path)
    return corpus.read_questions(spark, path).select("id", F.md5("pregunta").alias("pregunta_md5"), "seccion_fuente")


def _store(spark, d):
    """A fragment table with two tags; the first is then rebuilt with fewer rows."""
    path = shared_path(spark, "fragments")
    rows = _vectors(spark, d).withColumn("indice", F.when(F.col("fid") % 3 == 0, "other").otherwise(TAG))
    rows.write.partitionBy("indice").parquet(path)
    corpus.rebuild(rows.filter((F.col("indice") == TAG) & (F.col("flabel") < 5)), path)
    return spark.read.parquet(path)


STORE = f"store AS (SELECT vec_id AS fid, label AS flabel, CASE WHEN vec_id % 3 = 0 THEN 'other' ELSE '{TAG}' END AS indice FROM embeddings WHERE vec_id % 3 = 0 OR label < 5)"


@register(f"WITH {STORE} SELECT fid, CAST(flabel AS INTEGER) AS flabel, indice FROM store")
def rebuild_fragments(spark, d):
    return _store(spark, d).select("fid", F.col("flabel").cast("int").alias("flabel"), "indice")


@register("SELECT vec_id AS fid, 'guia_v3_bge-m3_c400o50' AS indice, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS checksum FROM embeddings")
def copy_fragments(spark, d):
    total = F.aggregate(scores.doubles(F.col("fv")), F.lit(0.0), lambda s, x: s + x)
    return corpus.copied(_vectors(spark, d), config.Settings(corpus_version="v3").tag).select("fid", "indice", F.round(total, 4).alias("checksum"))


@register(f"WITH {STORE} SELECT indice, count(*) AS n FROM store GROUP BY indice")
def fragment_counts(spark, d):
    return corpus.counts(_store(spark, d))


@register(f"SELECT '{TAG}' AS expected, 'other' AS found, count(*) AS n FROM embeddings WHERE vec_id % 3 = 0")
def index_tag_check(spark, d):
    own = _store(spark, d)
    corpus.require(own.filter(F.col("indice") == TAG), TAG)
    return own.filter(F.col("indice") != TAG).groupBy(F.lit(TAG).alias("expected"), F.col("indice").alias("found")).agg(F.count("*").alias("n"))


@register("SELECT CAST(doc_id AS VARCHAR) AS name, CASE WHEN doc_id % 10 = 0 THEN 'unlisted' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'match' END AS status FROM documents")
def fingerprint_check(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("name"), F.encode("text", "UTF-8").alias("content"))
    n = F.col("name").cast("long")
    manifest = files.filter(n % 10 != 0).select("name", F.sha2(F.when(n % 7 == 0, F.concat("content", F.lit(b"x"))).otherwise(F.col("content")), 256).alias("sha256"))
    return corpus.fingerprints(files, manifest)


@register()
def write_eval(spark, d):
    path = shared_path(spark, "results")
    corpus.write_results(evaluation.sweep(_scores(spark, d)), path)
    return spark.read.json(path)


# --- pages -----------------------------------------------------------------------------------------------------------


@register(f"WITH {P} SELECT doc_id, page FROM p WHERE {ALLOWED}")
def page_allowlist(spark, d):
    return pages.allowed(_pages(spark, d)).select("doc_id", "page")


@register(f"SELECT doc_id, {_words('text')} AS n_words FROM documents WHERE {_words('text')} >= 15")
def min_words(spark, d):
    return pages.long_enough(table(spark, d, "documents")).select("doc_id", text.word_count(F.col("text")).alias("n_words"))


@register(f"WITH {P} SELECT doc_id, page, md5(CASE WHEN page = 2 THEN '{config.OVERRIDES[0][1]}' ELSE text END) AS text_md5, page = 2 AS curated FROM p")
def page_override(spark, d):
    return pages.overridden(_pages(spark, d)).select("doc_id", "page", F.md5("text").alias("text_md5"), "curated")


@register(f"WITH {P}, {LOCATED} SELECT doc_id, page, seccion FROM located")
def asof_section(spark, d):
    return pages.as_of(_pages(spark, d), config.SECTIONS, "seccion").select("doc_id", "page", "seccion")


@register(
    """WITH k AS (SELECT l.doc_id AS label_id, d.source, max(l.quality) AS quality FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY ALL)
    SELECT d.doc_id, k.label_id, CAST(k.quality AS INTEGER) AS quality FROM documents d ASOF LEFT JOIN k ON k.source = d.source AND d.doc_id >= k.label_id"""
)
def asof_keyed(spark, d):
    """A document's last labelled predecessor of the same source: an as-of join with a dimension that grows with the table."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    labels = table(spark, d, "labels").join(docs, "doc_id").groupBy("source", F.col("doc_id").alias("label_id")).agg(F.max("quality").alias("quality"))
    return pages.as_of_keyed(docs, labels, "source", "doc_id", "label_id").select("doc_id", "entry.label_id", F.col("entry.quality").cast("int").alias("quality"))


@register(f"WITH {P}, {LOCATED} SELECT doc_id, page, seccion, actividad, herramienta FROM located")
def locate_page(spark, d):
    return pages.located(_pages(spark, d)).select("doc_id", "page", "seccion", "actividad", "herramienta")


@register(f"WITH {P}, {STAGED} SELECT doc_id, actividad, CAST(etapa AS VARCHAR) AS etapa FROM staged")
def stage_lookup(spark, d):
    return pages.located(_pages(spark, d)).select("doc_id", "actividad", F.col("etapa").cast("string").alias("etapa"))


@register(f"WITH {BLOCKS}, {FIGURES} SELECT doc_id, fig_id, md5(text) AS text_md5 FROM figures")
def figure_text(spark, d):
    parts = pages.figure_parts(pages.blocks_of(table(spark, d, "documents")))
    return pages.figure_texts(parts).select("doc_id", F.col("fig_id").cast("long").alias("fig_id"), F.md5("text").alias("text_md5"))


@register(
    f"""WITH {BLOCKS}, {FIGURES}, body AS (SELECT doc_id, string_agg(CASE WHEN b.kind = 'picture' THEN f.text ELSE b.text END, chr(10) || chr(10) ORDER BY b.pos) AS t,
      count_if(b.kind = 'picture') AS pictures FROM blocks b LEFT JOIN figures f ON f.doc_id = b.doc_id AND f.fig_id = b.pos WHERE b.kind <> 'footer' GROUP BY b.doc_id)
    SELECT doc_id, CAST(pictures AS BIGINT) AS pictures,
      md5(regexp_replace(regexp_replace(regexp_replace(t, '(?m)[ \\t\\r]+$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS text_md5 FROM body""".replace(
        "SELECT doc_id, string_agg", "SELECT b.doc_id, string_agg"
    )
)
def assemble_page(spark, d):
    blocks = pages.blocks_of(table(spark, d, "documents"))
    whole, _ = pages.assembled(blocks, pages.figure_texts(pages.figure_parts(blocks)))
    return whole.select("doc_id", "pictures", F.md5("text").alias("text_md5"))


_ENTITIES = [("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "''"), ("&amp;", "&")]
_UNESCAPED = "html"
for _a, _b in _ENTITIES:
    _UNESCAPED = f"replace({_UNESCAPED}, '{_a}', '{_b}')"


@register(
    f"SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace({_UNESCAPED}, '(?m)[ \\t\\r]+$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS text_md5 FROM pages"
)
def clean_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(text.tidy(text.references(F.col("html")))).alias("text_md5"))


@register(f"WITH {P}, {LOCATED} SELECT doc_id, {LABEL} AS fuente FROM located")
def citation_label(spark, d):
    return pages.located(_pages(spark, d)).select("doc_id", pages.label().alias("fuente"))


@register(f"WITH {BUILT} SELECT id, doc_id, md5(text) AS text_md5, fuente, pagina_inicio, pagina_fin, seccion, actividad, herramienta, CAST(etapa AS VARCHAR) AS etapa, version_corpus FROM built")
def build_pages(spark, d):
    return _built(spark, d).withColumns({"text_md5": F.md5("text"), "etapa": F.col("etapa").cast("string")}).drop("text")


@register(f"WITH {BUILT} SELECT count(*) AS pages, CAST(sum({_words('text')}) AS BIGINT) AS words, min(pagina_inicio) AS first_page, max(pagina_fin) AS last_page FROM built")
def corpus_stats(spark, d):
    return _built(spark, d).agg(
        F.count("*").alias("pages"), F.sum(text.word_count(F.col("text"))).alias("words"), F.min("pagina_inicio").alias("first_page"), F.max("pagina_fin").alias("last_page")
    )


@register(f"WITH {BUILT} SELECT id, doc_id, fuente FROM built WHERE pagina_inicio = 110")
def page_lookup(spark, d):
    return _built(spark, d).filter("pagina_inicio = 110").select("id", "doc_id", "fuente")


# --- fragments -------------------------------------------------------------------------------------------------------


def _fragments(spark, d, size=400, overlap=50):
    return fragments.fragments(table(spark, d, "documents").select("doc_id", "text"), size, overlap)


@register(f"WITH RECURSIVE {_chunks()} SELECT doc_id, pos, first, last, n_words, md5(text) AS text_md5 FROM chunks")
def chunk_sentences(spark, d):
    return _fragments(spark, d).withColumn("text_md5", F.md5("text")).drop("text")


@register(f"WITH RECURSIVE {_chunks()}, {P}, {STAGED} SELECT c.doc_id, c.pos, c.n_words, {LABEL} AS fuente, seccion, actividad, herramienta, coalesce(CAST(etapa AS INTEGER), 0) AS etapa FROM chunks c JOIN staged s ON s.doc_id = c.doc_id")
def fragments_with_meta(spark, d):
    rows = pages.located(_pages(spark, d)).withColumn("fuente", pages.label()).withColumn("etapa", F.coalesce("etapa", F.lit(0)))
    return fragments.fragments(rows).select("doc_id", "pos", "n_words", "fuente", "seccion", "actividad", "herramienta", "etapa")


@register(f"WITH {P}, {LOCATED} SELECT doc_id, md5('fuente: ' || {LABEL} || chr(10) || chr(10) || text) AS text_md5 FROM located")
def embed_text(spark, d):
    return pages.located(_pages(spark, d)).select("doc_id", F.md5(text.source_text(pages.label(), F.col("text"))).alias("text_md5"))


@register("SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')[1:64], ' ')) AS text_md5 FROM documents")
def truncate_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.truncated(F.col("text"), 64)).alias("text_md5"))


GRID = [(250, 0), (250, 50), (400, 50), (800, 50)]


@register(
    "\nUNION ALL\n".join(
        f"SELECT {s} AS size, {o} AS overlap, * FROM (WITH RECURSIVE {_chunks(s, o)} SELECT count(*) AS n, CAST(sum(n_words) AS BIGINT) AS words, max(n_words) AS longest FROM chunks)" for s, o in GRID
    )
)
def chunk_sweep(spark, d):
    return fragments.sweep(table(spark, d, "documents"), GRID)


# --- vectors ---------------------------------------------------------------------------------------------------------


@register()
def embed_fragments(spark, d):
    rows = retrieval.embedded(_fragments(spark, d), retrieval.hashing_encoder)
    return rows.select("doc_id", "pos", F.size("embedding").alias("dim"), F.round(scores.dot(F.col("embedding"), F.col("embedding")), 4).alias("norm"))


CELL = "CAST(CAST(('0x' || substr(md5({x}), 1, 8)) AS BIGINT) % 256 AS INTEGER) AS cell"
IDF = f"""df AS (SELECT {CELL.format(x="pair")}, count(DISTINCT id) AS n_texts FROM db GROUP BY 1),
  idf AS (SELECT CAST(g.cell AS INTEGER) AS cell, coalesce(n_texts, 0) AS n_texts, ln(((SELECT count(*) FROM documents) + 1) / (coalesce(n_texts, 0) + 1)) AS weight
    FROM range(256) g(cell) LEFT JOIN df USING (cell))"""
ENCODED = f"""{PAIRS}, {IDF},
  dt AS (SELECT id, cell, count(*) AS tf FROM (SELECT id, {CELL.format(x="pair")} FROM (SELECT id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS pair FROM dw WHERE len(t) > 1)) GROUP BY ALL),
  dv AS (SELECT id, cell, tf * weight AS w FROM dt JOIN idf USING (cell)),
  qv AS (SELECT DISTINCT qb.id, c.cell, weight AS w FROM qb, LATERAL (SELECT {CELL.format(x="qb.pair")}) c JOIN idf ON idf.cell = c.cell),
  dl AS (SELECT id, sqrt(sum(w * w)) AS l FROM dv GROUP BY id), ql AS (SELECT id, sqrt(sum(w * w)) AS l FROM qv GROUP BY id),
  dots AS (SELECT qv.id AS qid, dv.id AS fid, sum(qv.w * dv.w) AS dot FROM qv JOIN dv USING (cell) GROUP BY ALL),
  near AS (SELECT qid, fid, round(dot / (ql.l * dl.l), 6) AS score FROM dots JOIN ql ON ql.id = qid JOIN dl ON dl.id = fid)"""


def _encoder(spark, d):
    """The encoder as a service loads it: fitted on all documents, saved, read back."""
    path = shared_path(spark, "encoder")
    encoder.save(encoder.fit(table(spark, d, "documents")), path)
    return encoder.load(path)


@register(f"WITH {PAIRS}, {IDF} SELECT cell, CAST(n_texts AS BIGINT) AS n_texts, round(weight, 6) AS weight FROM idf")
def encoder_weights(spark, d):
    return encoder.weights(spark, _encoder(spark, d)).withColumn("weight", F.round("weight", 6))


@register(
    f"WITH {ENCODED} SELECT * FROM (SELECT qid, fid, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, fid) AS INTEGER) AS rank FROM near WHERE qid <> fid AND score > 0) WHERE rank <= 4"
)
def encoder_top4(spark, d):
    """Documents nearest to each benchmark item under the fitted encoder, in its question and its passage mode."""
    model = _encoder(spark, d)
    asked = encoder.encoded(table(spark, d, "benchmark"), model, is_query=True).select(F.col("item_id").alias("qid"), F.col("embedding").alias("qv"))
    found = encoder.encoded(table(spark, d, "documents"), model).select(F.col("doc_id").alias("fid"), F.col("embedding").alias("fv"))
    some = lambda v: F.exists(v, lambda x: x != 0)
    hits = retrieval.nearest(asked.filter(some("qv")), found.filter(some("fv")), config.DEFAULT.top_k).filter("score > 0")
    return hits.select("qid", "fid", "score", "rank")


@register(
    f"""WITH {PAIRS} SELECT 'questions' AS stage, count(*) AS rows, count(*) > 0 AS ran FROM benchmark UNION ALL SELECT 'candidates', count(*), TRUE FROM cand
    UNION ALL SELECT 'reranked', count(*), TRUE FROM hits UNION ALL SELECT 'passed', CAST(count_if(pair_score >= 0.5) AS BIGINT), TRUE FROM hits"""
)
def stage_timing(spark, d):
    """Rows of the stages of retrieval as the stage table has them; seconds, jobs and tasks are not constant, so only whether there were any is returned."""
    run = stages.Stages(spark)
    asked = run.run("questions", lambda: table(spark, d, "benchmark"))
    found = run.run("candidates", lambda: retrieval.lexical(asked, table(spark, d, "documents"), config.DEFAULT.candidates))
    top = run.run("reranked", lambda: retrieval.reranked(found, config.DEFAULT.top_k))
    run.run("passed", lambda: gate.above(top.select("qid", "fid", F.col("pair_score").alias("score"))))
    return run.table().select("stage", "rows", ((F.col("seconds") > 0) & (F.col("jobs") > 0) & (F.col("tasks") > 0)).alias("ran"))


@register(
    f"SELECT name, item_id, md5(document || text) AS document_md5, md5(query || text) AS query_md5 FROM benchmark, {_values([(n, a, b) for n, a, b in config.TEMPLATES], 'name, document, query')} t"
)
def apply_template(spark, d):
    templates = F.broadcast(spark.createDataFrame(config.TEMPLATES, "name string, document string, query string"))
    return table(spark, d, "benchmark").crossJoin(templates).select(
        "name", "item_id", F.md5(F.concat("document", "text")).alias("document_md5"), F.md5(F.concat("query", "text")).alias("query_md5")
    )


@register(f"WITH {VECTORS} SELECT vec_id, round(list_sum(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))), 6) AS total, round(sqrt(list_dot_product(v, v)), 6) AS length FROM e")
def l2_normalize(spark, d):
    v = F.col("embedding")
    total = F.aggregate(scores.normalized(v), F.lit(0.0), lambda s, x: s + x)
    return table(spark, d, "embeddings").select("vec_id", F.round(total, 6).alias("total"), F.round(F.sqrt(scores.dot(v, v)), 6).alias("length"))


@register(f"WITH {VECTORS}, {_knn(20)} SELECT qid, fid, score, CAST(rank AS INTEGER) AS rank FROM knn")
def knn_top20(spark, d):
    return retrieval.nearest(_questions(spark, d), _vectors(spark, d), config.DEFAULT.n_candidates(True))


@register(f"WITH {VECTORS}, {_knn(4, where='(q.label = 0 OR q.label IS NULL OR f.label = q.label)')} SELECT qid, fid, score, CAST(rank AS INTEGER) AS rank FROM knn")
def knn_filtered(spark, d):
    """From a table stored by stage, of which only the stages asked for are read."""
    path = shared_path(spark, "by_stage")
    vector_index.write_by_stage(_vectors(spark, d), path)
    return vector_index.nearest_in_stage(_questions(spark, d), path, config.DEFAULT.top_k)


@register()
def ann_recall(spark, d):
    """Recall of the stored cell index against exact search, and which share of its cells a question reads."""
    questions, vectors, path = _questions(spark, d), _vectors(spark, d), shared_path(spark, "cells")
    vector_index.write_cells(vectors, path)
    exact = retrieval.nearest(questions, vectors, 20).select("qid", "fid")
    found = vector_index.search_cells(questions, path, 20).select("qid", "fid", F.lit(1).alias("found"))
    cells = spark.read.parquet(f"{path}/centres").agg(F.count("*").alias("cells"), F.max("probes").alias("probes"))
    recall = exact.join(found, ["qid", "fid"], "left").agg(F.count("*").alias("neighbours"), F.round(F.avg(F.coalesce("found", F.lit(0))), 3).alias("recall"))
    return recall.join(F.broadcast(cells), F.lit(True)).withColumn("share", F.round(F.col("probes") / F.col("cells"), 3))


@register(f"WITH {VECTORS}, {_knn(20)} SELECT qid, fid, round(1 - score, 6) AS linear, round(-ln(score), 6) AS exponential FROM knn WHERE score > 0")
def score_to_distance(spark, d):
    hits = retrieval.nearest(_questions(spark, d), _vectors(spark, d), 20).filter("score > 0")
    return hits.select("qid", "fid", F.round(scores.distance(F.col("score"), "linear"), 6).alias("linear"), F.round(scores.distance(F.col("score"), "exp"), 6).alias("exponential"))


# --- rerank, gate, answer --------------------------------------------------------------------------------------------


@register(f"WITH {PAIRS} SELECT qid, fid, score, pair_score, CAST(rank AS INTEGER) AS rank, CAST(final_rank AS INTEGER) AS final_rank FROM hits")
def rerank_top4(spark, d):
    return retrieval.reranked(_candidates(spark, d), config.DEFAULT.top_k)


def _by_length(spark, d):
    path = shared_path(spark, "by_length")
    pair_index.write_by_length(table(spark, d, "documents"), path)
    return pair_index.search(table(spark, d, "benchmark"), path, config.DEFAULT.candidates)


@register(f"WITH {PAIRS} SELECT qid, fid, score, pair_score, CAST(rank AS INTEGER) AS rank FROM cand")
def lexical_bounded(spark, d):
    """The candidates from a stored index whose frequent pairs are passed over where scores can't reach the top."""
    return _by_length(spark, d)[0]


@register()
def lexical_reads(spark, d):
    """How many postings each step of the bounded search reads, of all that the questions' pairs have."""
    return _by_length(spark, d)[1]


@register(f"WITH {PAIRS} SELECT qid, fid, pair_score, CAST(rank AS INTEGER) AS rank, CAST(final_rank AS INTEGER) AS final_rank FROM hits")
def rerank_injected(spark, d):
    """Rerank by a pair scorer that reads the texts (here without a model)."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    pairs = _candidates(spark, d).select("qid", "fid", "rank").join(asked, "qid").join(table(spark, d, "documents").select(F.col("doc_id").alias("fid"), "text"), "fid")
    return retrieval.rerank_with(pairs, retrieval.shared_pairs_scorer, config.DEFAULT.top_k).select("qid", "fid", "pair_score", "rank", "final_rank")


@register(f"WITH {VECTORS}, {_knn(4)} SELECT qid, fid, round(1 / (1 + exp(-(8 * score - 4))), 6) AS score FROM knn")
def sigmoid_score(spark, d):
    hits = retrieval.nearest(_questions(spark, d), _vectors(spark, d), 4)
    return hits.select("qid", "fid", F.round(scores.sigmoid(8 * F.col("score") - 4), 6).alias("score"))


@register(f"WITH {PAIRS} SELECT qid, fid, score FROM top WHERE score >= 0.5")
def threshold_cut(spark, d):
    return gate.above(_hits(spark, d)).select("qid", "fid", "score")


GATE = "gate AS (SELECT q.qid, count_if(coalesce(t.score >= 0.5, FALSE)) > 0 AS found, round(max(t.score), 3) AS best, count_if(coalesce(t.score >= 0.5, FALSE)) AS n_kept FROM quest q LEFT JOIN top t USING (qid) GROUP BY q.qid)"


@register(f"WITH {PAIRS}, {GATE} SELECT qid, found, best, CAST(n_kept AS BIGINT) AS n_kept FROM gate")
def refusal_gate(spark, d):
    return gate.gated(_asked(spark, d), _hits(spark, d))


CONFIDENCE = "CASE WHEN best >= 0.9 THEN 'alta' WHEN best >= 0.7 THEN 'media' ELSE 'baja' END"


@register(f"WITH {VECTORS}, {_knn(1)} SELECT qid, best, {CONFIDENCE} AS confianza FROM (SELECT qid, round(1 / (1 + exp(-(8 * score - 2.5))), 3) AS best FROM knn)")
def confidence_bucket(spark, d):
    best = scores.sigmoid(8 * F.col("score") - 2.5)
    hits = retrieval.nearest(_questions(spark, d), _vectors(spark, d), 1)
    return hits.select("qid", F.round(best, 3).alias("best"), scores.confidence(best).alias("confianza"))


CITED = f"{P}, {LOCATED}, cited AS (SELECT t.qid, t.rank, t.score, l.*, {LABEL} AS fuente FROM top t JOIN located l ON l.doc_id = t.fid WHERE t.score >= 0.5)"


@register(
    f"WITH {PAIRS}, {CITED} SELECT qid, CAST(rank AS INTEGER) AS rank, coalesce(nullif(herramienta, ''), nullif(actividad, ''), seccion) AS seccion, page AS pagina, fuente, md5(substr(text, 1, 300)) AS fragmento_md5, round(score, 3) AS puntaje FROM cited"
)
def citations(spark, d):
    return gate.cited(_cited(spark, d)).withColumn("fragmento_md5", F.md5("fragmento")).drop("fragmento")


CONTEXT = f"ctx AS (SELECT qid, string_agg('fuente: ' || fuente || chr(10) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM cited GROUP BY qid)"


@register(f"WITH {PAIRS}, {CITED}, {CONTEXT} SELECT qid, md5(context) AS context_md5 FROM ctx")
def context_text(spark, d):
    return gate.contexts(_cited(spark, d)).select("qid", F.md5("context").alias("context_md5"))


@register(
    f"""WITH {PAIRS}, {CITED}, {CONTEXT} SELECT qid, md5('Stage: ' || CASE WHEN qid % 9 = 0 THEN 'not given' ELSE coalesce(s.name, CAST(qid % 9 AS VARCHAR)) END || chr(10) || chr(10) || 'Context:' || chr(10) || context
      || chr(10) || chr(10) || 'Question: ' || b.text) AS prompt_md5 FROM ctx JOIN benchmark b ON b.item_id = qid LEFT JOIN {_values(config.STAGES, "n, name")} s ON s.n = qid % 9"""
)
def render_prompt(spark, d):
    return gate.prompts(_asked(spark, d), gate.contexts(_cited(spark, d))).select("qid", F.md5("prompt").alias("prompt_md5"))


@register(f"WITH {PAIRS}, {CITED} SELECT qid, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS answer_md5 FROM cited WHERE rank = 1")
def answer_batch(spark, d):
    prompt = gate.prompts(_asked(spark, d), gate.contexts(_cited(spark, d)))
    return gate.answered(prompt, gate.extractive).select("qid", F.md5("answer").alias("answer_md5"))


@register(
    f"""WITH {PAIRS}, {GATE}, said AS (SELECT g.*, CASE WHEN found AND qid % 6 = 0 THEN '{config.REFUSAL} Really.' WHEN found THEN 'Answer ' || qid END AS answer FROM gate g)
    SELECT qid, CASE WHEN found THEN answer ELSE '{config.REFUSAL} {config.ADVICE}' END AS resultado, found AND qid % 6 <> 0 AS encontrada,
      CASE WHEN found AND qid % 6 <> 0 THEN {CONFIDENCE} END AS confianza, best AS puntaje FROM said"""
)
def classify_answer(spark, d):
    g = gate.gated(_asked(spark, d), _hits(spark, d))
    said = F.when(F.col("qid") % 6 == 0, f"{config.REFUSAL} Really.").otherwise(F.concat(F.lit("Answer "), F.col("qid").cast("string")))
    return gate.classified(g, g.filter("found").select("qid", said.alias("answer")))


@register(
    """SELECT conv_id, turn, CASE WHEN length(coalesce(text, '')) < 1 THEN 'empty' WHEN length(text) > 1000 THEN 'too long' WHEN trim(text) = '' THEN 'blank'
      WHEN conv_id % 10 > 7 OR (conv_id % 10 < 1 AND conv_id % 20 <> 0) THEN 'stage' END AS reason FROM conversations WHERE role = 'user'"""
)
def validate_requests(spark, d):
    stage = F.when(F.col("conv_id") % 20 != 0, F.col("conv_id") % 10)
    return gate.checked(table(spark, d, "conversations").filter("role = 'user'").withColumn("stage", stage)).select("conv_id", "turn", "reason")


def _arriving(spark, rows, path):
    """rows as a stream of the files in path."""
    rows.write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def _stream_requests(spark, d):
    asked = _arriving(spark, table(spark, d, "benchmark"), shared_path(spark, "arriving"))
    return asked.select(F.col("item_id").alias("qid"), F.col("text").alias("question"), (F.col("item_id") % 9).cast("int").alias("stage"))


def _located_pages(spark, d):
    return pages.located(_pages(spark, d)).withColumn("fuente", pages.label())


@register()
def stream_answers(spark, d):
    """Benchmark items arrive as a stream; the answers equal those of the batch."""
    rows, index, path = _located_pages(spark, d), shared_path(spark, "index"), shared_path(spark, "answers")
    page_index.append(rows, index, 0)
    answers.start(_stream_requests(spark, d), index, path, shared_path(spark, "offsets")).awaitTermination()
    return spark.read.parquet(path).drop("batch")


def _growth(phase: str, where: str) -> str:
    own = PAIRS.replace("FROM documents)", f"FROM documents WHERE {where})", 1)
    return f"SELECT * FROM (WITH {own} SELECT b.item_id AS qid, '{phase}' AS phase, count_if(coalesce(h.pair_score >= 0.5, FALSE)) > 0 AS found, round(max(h.pair_score), 3) AS best FROM benchmark b LEFT JOIN hits h ON h.qid = b.item_id GROUP BY b.item_id)"


@register(f"{_growth('early', 'doc_id % 2 = 0')} UNION ALL {_growth('late', 'TRUE')}")
def stream_growing_index(spark, d):
    """Half of the pages are indexed, questions stream; the other half arrives, and the same questions stream again."""
    rows, index, source, offsets = _located_pages(spark, d), shared_path(spark, "index"), shared_path(spark, "source"), shared_path(spark, "offsets")
    page_index.create(spark, index, rows.schema)
    found = []
    for phase, half in (("early", 0), ("late", 1)):
        arriving = _arriving(spark, rows.filter(F.col("doc_id") % 2 == half), source)
        page_index.follow(arriving, index, offsets).awaitTermination()
        path = shared_path(spark, phase)
        answers.start(_stream_requests(spark, d), index, path, shared_path(spark, "offsets")).awaitTermination()
        found.append(spark.read.parquet(path).select("qid", F.lit(phase).alias("phase"), F.col("encontrada").alias("found"), F.col("puntaje").alias("best")))
    return found[0].unionByName(found[1])


# --- evaluation ------------------------------------------------------------------------------------------------------


@register("SELECT source, lower(trim(strip_accents(source))) AS name, count(*) AS n FROM (SELECT 'Sección ' || upper(lang) || ' ' || source AS source FROM documents) GROUP BY ALL")
def norm_name(spark, d):
    named = F.concat(F.lit("Sección "), F.upper("lang"), F.lit(" "), F.col("source"))
    counted = table(spark, d, "documents").groupBy(named.alias("source")).agg(F.count("*").alias("n"))
    return counted.select("source", text.plain_name("source").alias("name"), "n")


FIRST = "first AS (SELECT q.vec_id AS qid, min(CASE WHEN k.flabel = k.qlabel THEN k.rank END) AS hit_rank FROM e q LEFT JOIN knn k ON k.qid = q.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id)"


def _runs(spark, d):
    return _rankings(spark, d, 20).select(F.lit("dense").alias("run"), "qid", "rank", (F.col("qlabel") == F.col("flabel")).alias("hit"))


@register(f"WITH {VECTORS}, {_knn(20)}, {FIRST} SELECT 'dense' AS run, qid, CAST(hit_rank AS VARCHAR) AS hit_rank FROM first")
def first_hit_rank(spark, d):
    hits = evaluation.first_hits(_runs(spark, d), _questions(spark, d), 20, ["dense"])
    return hits.withColumn("hit_rank", F.col("hit_rank").cast("string"))


@register(
    f"WITH {VECTORS}, {_knn(4)} SELECT qid, max(coalesce(qid % 168 + 1 BETWEEN fid % 168 AND fid % 168 + 2, FALSE)) AS page_hit FROM knn GROUP BY qid"
)
def page_hit(spark, d):
    hits = retrieval.nearest(_questions(spark, d), _vectors(spark, d), 4)
    rows = hits.select("qid", "rank", (F.col("qid") % 168 + 1).alias("page"), (F.col("fid") % 168).alias("pagina_inicio"), (F.col("fid") % 168 + 2).alias("pagina_fin"))
    return evaluation.page_hits(rows, 4)


#: A vector's page and the name that its question expects: the page's most specific one, in capitals.
PLACES = f"""p AS (SELECT vec_id AS doc_id, CAST(vec_id % 168 + 1 AS INTEGER) AS page, '' AS text FROM embeddings), {LOCATED},
  named AS (SELECT doc_id, lower(seccion) AS s, lower(actividad) AS a, lower(herramienta) AS t, lower(trim(upper(coalesce(nullif(herramienta, ''), nullif(actividad, ''), seccion)))) AS expected FROM located)"""


@register(
    f"""WITH {VECTORS}, {_knn(20)}, {PLACES} SELECT q.vec_id AS qid, CAST(min(CASE WHEN n.a = x.expected OR n.t = x.expected OR n.s = x.expected THEN k.rank END) AS VARCHAR) AS hit_rank
      FROM e q JOIN named x ON x.doc_id = q.vec_id LEFT JOIN knn k ON k.qid = q.vec_id LEFT JOIN named n ON n.doc_id = k.fid WHERE q.vec_id % {EVERY} = 0 GROUP BY q.vec_id"""
)
def named_hit_rank(spark, d):
    """First hit by name: activity, tool or section equal to the expected one, case and accents aside."""
    numbers = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), (F.col("vec_id") % 168 + 1).cast("int").alias("page"))
    places = pages.located(numbers).select(F.col("doc_id").alias("fid"), "seccion", "actividad", "herramienta")
    name = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("herramienta", "actividad")), F.col("seccion"))
    expected = places.select(F.col("fid").alias("qid"), F.upper(name).alias("expected"))
    hits = retrieval.nearest(_questions(spark, d), _vectors(spark, d), 20).join(places, "fid").join(expected, "qid")
    ranks = evaluation.first_hits(evaluation.named_hits(hits).withColumn("run", F.lit("dense")), _questions(spark, d), 20, ["dense"])
    return ranks.select("qid", F.col("hit_rank").cast("string").alias("hit_rank"))


@register(
    f"""WITH {VECTORS}, {_knn(4)}, h AS (SELECT q.vec_id AS qid, max(coalesce(q.vec_id % 168 + 1 BETWEEN fid % 168 AND fid % 168 + 2, FALSE)) AS hit FROM e q LEFT JOIN knn ON knn.qid = q.vec_id WHERE q.vec_id % {EVERY} = 0 GROUP BY q.vec_id)
    SELECT count(*) AS questions, round(100.0 * count_if(hit) / count(*), 1) AS recall_page, CAST(count_if(NOT hit) AS BIGINT) AS misses FROM h"""
)
def recall_page(spark, d):
    return evaluation.page_metrics(page_hit(spark, d), _questions(spark, d))


def _measures(k: int) -> str:
    return f"""SELECT CAST({k} AS INTEGER) AS k, count(*) AS questions, round(100.0 * count(CASE WHEN hit_rank <= {k} THEN 1 END) / count(*), 1) AS recall,
      round(sum(CASE WHEN hit_rank <= {k} THEN 1.0 / hit_rank ELSE 0.0 END) / count(*), 3) AS mrr, CAST(count_if(coalesce(hit_rank > {k}, TRUE)) AS BIGINT) AS misses FROM first"""


@register(f"WITH {VECTORS}, {_knn(20)}, {FIRST} {_measures(4)} UNION ALL {_measures(20)}")
def retrieval_metrics(spark, d):
    runs, questions = materialized(_runs(spark, d), "runs"), _questions(spark, d)
    out = [evaluation.metrics(evaluation.first_hits(runs, questions, k, ["dense"])).select(F.lit(k).alias("k"), "questions", "recall", "mrr", "misses") for k in (4, 20)]
    return out[0].unionByName(out[1])


@register(f"WITH {VECTORS}, {_knn(20)}, {FIRST} SELECT 'dense' AS run, qid FROM first WHERE coalesce(hit_rank > 4, TRUE)")
def retrieval_misses(spark, d):
    return evaluation.first_hits(_runs(spark, d), _questions(spark, d), 4, ["dense"]).filter("hit_rank is null").select("run", "qid")


#: A second encoder: only the first half of each vector.
HALF = VECTORS.replace("CAST(embedding AS DOUBLE[])", "CAST(embedding[1:32] AS DOUBLE[])").replace("e AS", "e AS", 1)


@register(
    "\nUNION ALL\n".join(
        f"SELECT '{run}' AS run, round(100.0 * count(CASE WHEN hit_rank <= 4 THEN 1 END) / count(*), 1) AS recall4, round(100.0 * count(hit_rank) / count(*), 1) AS recall20 FROM (WITH {v}, {_knn(20)}, {FIRST} SELECT * FROM first)"
        for run, v in (("full", VECTORS), ("half", HALF))
    )
)
def compare_encoders(spark, d):
    def run(name, cut):
        q, f = _questions(spark, d), _vectors(spark, d)
        if cut:
            q, f = q.withColumn("qv", F.slice("qv", 1, 32)), f.withColumn("fv", F.slice("fv", 1, 32))
        hits = retrieval.nearest(q, f, 20).join(q.select("qid", "qlabel"), "qid").join(f.select("fid", "flabel"), "fid")
        return hits.select(F.lit(name).alias("run"), "qid", "rank", (F.col("qlabel") == F.col("flabel")).alias("hit"))

    hits = evaluation.first_hits(run("full", False).unionByName(run("half", True)), _questions(spark, d), 20, ["full", "half"])
    return hits.groupBy("run").agg(F.round(100.0 * F.count_if(F.col("hit_rank") <= 4) / F.count("*"), 1).alias("recall4"), F.round(100.0 * F.count("hit_rank") / F.count("*"), 1).alias("recall20"))


@register(
    f"""WITH {PAIRS}, d1 AS (SELECT q.qid, min(CASE WHEN x.fid IS NOT NULL AND c.rank <= 4 THEN c.rank END) AS dense, min(CASE WHEN t.hit THEN t.rank END) AS reranked FROM quest q
      LEFT JOIN cand c USING (qid) LEFT JOIN held x USING (qid, fid) LEFT JOIN top t USING (qid) WHERE q.category = 'respondible' GROUP BY q.qid)
    SELECT count(*) AS questions, round(100.0 * count(dense) / count(*), 1) AS dense, round(100.0 * count(reranked) / count(*), 1) AS reranked FROM d1"""
)
def compare_rerank(spark, d):
    index = _index(spark, d)
    candidates = materialized(_candidates(spark, d, index), "candidates")
    held = _held(spark, d, index)
    dense = candidates.filter("rank <= 4").select(F.lit("dense").alias("run"), "qid", "fid", "rank")
    second = retrieval.reranked(candidates, 4).select(F.lit("reranked").alias("run"), "qid", "fid", F.col("final_rank").alias("rank"))
    runs = dense.unionByName(second).join(held, ["qid", "fid"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    hits = evaluation.first_hits(runs, held.select("qid").distinct(), 4, ["dense", "reranked"])
    per = evaluation.metrics(hits).select("questions", "run", "recall")
    return per.groupBy("questions").pivot("run", ["dense", "reranked"]).agg(F.first("recall"))


@register(f"WITH {PAIRS} SELECT qid, category, scores, best, CAST(hit_rank AS VARCHAR) AS hit_rank, hit_score FROM st")
def score_table(spark, d):
    listed = F.array_join(F.transform("scores", lambda x: F.format_string("%.4f", x)), ",")
    return _scores(spark, d).withColumns({"scores": listed, "hit_rank": F.col("hit_rank").cast("string")})


@register(f"WITH {PAIRS}, {SWEEP} SELECT umbral, rechazo_fuera, falsos_no_encuentro, recall, ambiguas_rechazadas FROM sweep")
def threshold_sweep(spark, d):
    return evaluation.sweep(_scores(spark, d))


@register(
    f"WITH {PAIRS}, {SWEEP} SELECT count(*) AS n, min(umbral) AS lowest, max(umbral) AS highest, coalesce(string_agg(printf('%.2f', umbral), ',' ORDER BY umbral), '') AS thresholds FROM sweep WHERE falsos_no_encuentro = 0 AND rechazo_fuera = 100"
)
def safe_thresholds(spark, d):
    return evaluation.safe(evaluation.sweep(_scores(spark, d)))


@register(
    f"""WITH {PAIRS} SELECT lo AS desde, least(hi, 1.0) AS hasta, CAST(coalesce(count_if(category = 'respondible'), 0) AS BIGINT) AS respondibles,
      CAST({_pct("count_if(category = 'respondible' AND hit_rank = 1)", "coalesce(count_if(category = 'respondible'), 0)")} AS DOUBLE) AS seccion_primera, CAST(coalesce(count_if(category = 'fuera'), 0) AS BIGINT) AS fuera
      FROM {_values(list(zip(config.BANDS, config.BANDS[1:])), "lo, hi")} g LEFT JOIN st ON best >= lo AND best < hi GROUP BY lo, hi"""
)
def score_bands(spark, d):
    return evaluation.bands(_scores(spark, d))


@register(
    f"""WITH {PAIRS} SELECT (SELECT qid FROM st WHERE category = 'respondible' ORDER BY best, qid LIMIT 1) AS weakest, (SELECT min(best) FROM st WHERE category = 'respondible') AS weakest_score,
      (SELECT qid FROM st WHERE category = 'fuera' ORDER BY best DESC, qid LIMIT 1) AS strongest, (SELECT max(best) FROM st WHERE category = 'fuera') AS strongest_score"""
)
def class_gap(spark, d):
    return evaluation.class_gap(_scores(spark, d))


@register(
    f"""WITH {VECTORS}, {_knn(20)}, b AS (SELECT qid, fid, CASE WHEN qid % 4 = 0 AND rank <= 2 THEN 3 - rank ELSE rank END AS rank, 1 - score AS d FROM knn),
      per AS (SELECT k.qid, count_if(least(k.rank, b.rank) <= 4 AND k.rank <> b.rank) = 0 AS same_top, max(abs(1 - k.score - b.d)) AS gap FROM knn k JOIN b USING (qid, fid) GROUP BY k.qid)
    SELECT round(100.0 * count_if(same_top) / count(*), 1) AS same_top, 100.0::DOUBLE AS same_set, round(max(gap), 6) AS max_gap, CAST(count_if(NOT same_top) AS BIGINT) AS differing FROM per"""
)
def store_agreement(spark, d):
    a = retrieval.nearest(_questions(spark, d), _vectors(spark, d), 20).withColumn("distance", scores.distance(F.col("score"), "linear"))
    return evaluation.agreement(a, evaluation.swapped(a), 4)


@register(
    f"""WITH {VECTORS}, {_knn(20)}, {HALF.replace("e AS", "e2 AS", 1)}, {_knn(20, "half").replace("e q JOIN e f", "e2 q JOIN e2 f")},
      per AS (SELECT qid, count_if(coalesce(least(k.rank, b.rank) <= 4 AND k.rank IS DISTINCT FROM b.rank, TRUE)) = 0 AS same_top, count_if(k.rank IS NULL OR b.rank IS NULL) = 0 AS same_set,
        max(abs((1 - k.score) - (1 - b.score))) AS gap FROM knn k FULL JOIN half b USING (qid, fid) GROUP BY qid)
    SELECT round(100.0 * count_if(same_top) / count(*), 1) AS same_top, round(100.0 * count_if(same_set) / count(*), 1) AS same_set, round(max(gap), 6) AS max_gap, CAST(count_if(NOT same_top) AS BIGINT) AS differing FROM per"""
)
def store_difference(spark, d):
    """Agreement of two stores whose candidates differ: whole vectors and their first halves."""
    q, f = _questions(spark, d), _vectors(spark, d)
    half = retrieval.nearest(q.withColumn("qv", F.slice("qv", 1, 32)), f.withColumn("fv", F.slice("fv", 1, 32)), 20)
    a, b = (x.withColumn("distance", scores.distance(F.col("score"), "linear")) for x in (retrieval.nearest(q, f, 20), half))
    return evaluation.agreement(a, b, 4)


# --- conversations ---------------------------------------------------------------------------------------------------

ROLLUP = f"""rollup AS (SELECT conv_id, coalesce(substr(min_by(trim(text), turn) FILTER (WHERE role = 'user' AND trim(text) <> ''), 1, {conversations.TITLE_CHARS}), '{conversations.DEFAULT_TITLE}') AS title,
  coalesce(max_by(trim(text), turn) FILTER (WHERE role = 'user' AND trim(text) <> ''), '{conversations.DEFAULT_PREVIEW}') AS preview, count(*) AS turns FROM conversations GROUP BY conv_id)"""


@register(f"WITH {ROLLUP} SELECT conv_id, title, md5(preview) AS preview_md5, turns FROM rollup")
def conversation_rollup(spark, d):
    return conversations.rollup(table(spark, d, "conversations")).select("conv_id", "title", F.md5("preview").alias("preview_md5"), "turns")


@register(f"WITH {ROLLUP} SELECT conv_id, title FROM rollup WHERE contains(lower(title || ' ' || preview), 'tion')")
def conversation_search(spark, d):
    return conversations.search(conversations.rollup(table(spark, d, "conversations")), "TION").select("conv_id", "title")


PATCHED = """WITH patch AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'patched ' || turn END AS text, CASE WHEN conv_id % 2 = 0 THEN 'error' END AS role FROM conversations WHERE role = 'assistant' AND conv_id % 3 = 0)
    SELECT c.conv_id, c.turn, coalesce(p.role, c.role) AS role, md5(coalesce(p.text, c.text)) AS text_md5 FROM conversations c LEFT JOIN patch p ON p.conv_id = c.conv_id AND p.turn = c.turn"""
MESSAGE, PATCHABLE = ["conv_id", "turn"], ["text", "role"]


def _patches(turns):
    """Two patches of some messages, the second of which counts."""
    own = turns.filter("role = 'assistant' and conv_id % 3 = 0")
    first = own.select("conv_id", "turn", F.lit("superseded").alias("text"), F.lit("user").alias("role"), F.lit(1).alias("seq"))
    text_ = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("patched "), F.col("turn").cast("string")))
    last = own.select("conv_id", "turn", text_.alias("text"), F.when(F.col("conv_id") % 2 == 0, "error").alias("role"), F.lit(2).alias("seq"))
    return first.unionByName(last)


def _digest(messages):
    return messages.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@register(PATCHED)
def message_patch(spark, d):
    turns = table(spark, d, "conversations")
    return _digest(conversations.patched(turns, _patches(turns), MESSAGE, PATCHABLE))


@register(PATCHED)
def message_patch_stream(spark, d):
    """The same patches as a stream of three deliveries: the newest ones first, then the older ones, then all once more."""
    turns, source, path = table(spark, d, "conversations"), shared_path(spark, "patches"), shared_path(spark, "newest")
    own = _patches(turns)
    for part in (own.filter("seq = 2"), own.filter("seq = 1"), own):
        part.write.mode("append").parquet(source)
        arriving = spark.readStream.schema(own.schema).parquet(source)
        patches.start(arriving, path, MESSAGE, PATCHABLE, f"{source}-offsets").awaitTermination()
    return _digest(patches.applied(turns, path, MESSAGE, PATCHABLE))


@register("SELECT conv_id, max_by(role, turn) = 'user' AS pending FROM conversations GROUP BY conv_id")
def pending_conversations(spark, d):
    return conversations.pending(table(spark, d, "conversations"))
