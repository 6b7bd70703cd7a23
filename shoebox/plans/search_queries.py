"""Search by filename, metadata and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoebox.functions import vectors as V
from shoebox.operators import canonical as C, search as Q, text_index, vector_index
from shoebox.plans.canonical_queries import CANON
from shoebox.plans.registry import query
from shoebox.request import SearchRequest, resolve
from shoebox.session import shared_dir
from shoebox.sources.snapshots import Snapshots

#: A query vector: the model that makes one from text is not part of this engine.
QUERY = [((i * 37) % 64 - 31.5) / 160.0 for i in range(64)]
LIST = "[" + ", ".join(repr(q) for q in QUERY) + "]::DOUBLE[]"
SCORED = f"scored AS (SELECT *, list_dot_product(vector::DOUBLE[], {LIST}) AS score FROM vectors), ranking AS (SELECT *, row_number() OVER (ORDER BY score DESC, captured_at DESC, source_key, id) - 1 AS rank FROM scored)"
LIKE = "(lower(filename) LIKE '%19%' OR lower(coalesce(place_label, '')) LIKE '%19%' OR lower(coalesce(description, '')) LIKE '%19%')"


@query("filename_search", f"WITH {CANON} SELECT canonical_asset_id, filename FROM canon c WHERE EXISTS (SELECT 1 FROM linked l WHERE l.canonical_asset_id = c.canonical_asset_id AND l.visibility_status = 'active' AND lower(l.filename) LIKE '%7.jp%')")
def filename_search(source_rows):
    rows = C.with_canonical_ids(source_rows)
    return Q.by_filename(C.canonical_assets(rows), rows, " 7.JP ").select("canonical_asset_id", "filename")


@query("metadata_search", f"SELECT source_key, upstream_asset_id FROM source_rows WHERE visibility_status = 'active' AND {LIKE}")
def metadata_search(source_rows):
    return Q.by_metadata(source_rows, "19").select(*C.KEY)


@query("favorite_search", "SELECT source_key, upstream_asset_id FROM source_rows WHERE visibility_status = 'active' AND (is_favorite OR lower(filename) LIKE '%starred%' OR lower(coalesce(place_label, '')) LIKE '%starred%' OR lower(coalesce(description, '')) LIKE '%starred%')")
def favorite_search(source_rows):
    return Q.by_metadata(source_rows, "Starred").select(*C.KEY)


@query("phrase_search", "SELECT source_key, upstream_asset_id FROM source_rows WHERE contains(lower(coalesce(description, '')), 'er th')")
def phrase_search(source_rows):
    return source_rows.where(Q.has_text(F.col("description"), "ER th")).select(*C.KEY)


def text_index_of(rows, keys, fields):
    return text_index.TextIndex(Snapshots(rows.sparkSession, shared_dir(rows.sparkSession, "text-index")), keys, fields)


def library_texts(documents):
    """What source_rows has of texts, without its join, so that no text is shuffled."""
    key = F.col("doc_id").cast("string")
    filename = F.concat(F.lit("IMG_"), key, F.when(F.col("doc_id") % 4 == 0, ".mp4").otherwise(".JPG"))
    return documents.select(F.col("source").alias("source_key"), key.alias("upstream_asset_id"), filename.alias("filename"), F.col("lang").alias("place_label"), F.col("text").alias("description"))


def active_of(found, source_rows):
    return found.join(source_rows.where("visibility_status = 'active'").select(*C.KEY), [*C.KEY], "left_semi")


@query("phrase_search_indexed", "SELECT source_key, upstream_asset_id FROM source_rows WHERE contains(lower(coalesce(description, '')), 'er threa')")
def phrase_search_indexed(documents):
    """By trigrams of whole texts; only candidates' texts are read again."""
    index = text_index_of(documents, [*C.KEY], ["description"])
    index.apply(library_texts(documents).select(*C.KEY, "description"))
    return index.search(" er THREA ").select(*C.KEY)


@query("filename_search_indexed", "SELECT source_key, upstream_asset_id, filename FROM source_rows WHERE visibility_status = 'active' AND lower(filename) LIKE '%7.jp%'")
def filename_search_indexed(documents, source_rows):
    index = text_index_of(documents, [*C.KEY], ["filename"])
    index.apply(library_texts(documents).select(*C.KEY, "filename"))
    return active_of(index.search("7.JP").select(*C.KEY, "filename"), source_rows)


IN_ANY = "(contains(lower(filename), '{0}') OR contains(lower(coalesce(place_label, '')), '{0}') OR contains(lower(coalesce(description, '')), '{0}'))"


@query("metadata_search_indexed", f"SELECT source_key, upstream_asset_id FROM source_rows WHERE visibility_status = 'active' AND {IN_ANY.format('199')}")
def metadata_search_indexed(documents, source_rows):
    """Filename, place and description in one index."""
    index = text_index_of(documents, [*C.KEY], ["filename", "place_label", "description"])
    index.apply(library_texts(documents))
    return active_of(index.search("199").select(*C.KEY), source_rows)


@query("phrase_search_after_changes", "SELECT source_key, upstream_asset_id FROM (SELECT source_key, upstream_asset_id, CASE WHEN CAST(upstream_asset_id AS BIGINT) % 10 < 3 THEN coalesce(place_label, '') || ' new threads' ELSE description END AS d FROM source_rows WHERE CAST(upstream_asset_id AS BIGINT) % 10 < 7) WHERE contains(lower(coalesce(d, '')), 'threa')")
def phrase_search_after_changes(documents):
    """Rows come, some go, some get another text; then a search of the three segments."""
    digit = F.col("upstream_asset_id").cast("bigint") % 10
    rows = library_texts(documents).select(*C.KEY, "place_label", "description", digit.alias("digit"))
    index = text_index_of(rows, [*C.KEY], ["description"])
    index.apply(rows.where("digit < 5 OR digit = 9"))
    index.apply(rows.where("digit BETWEEN 5 AND 8"))
    changed = rows.where("digit < 3").withColumn("description", F.concat(F.coalesce("place_label", F.lit("")), F.lit(" new threads")))
    index.apply(changed, gone=rows.where("digit > 6"))
    return index.search("threa").select(*C.KEY)


@query("dot_products", "SELECT a.id AS a, b.id AS b, round(list_dot_product(a.vector::DOUBLE[], b.vector::DOUBLE[]), 6) AS dot FROM vectors a JOIN vectors b ON b.id = a.id + 1")
def dot_products(vectors):
    b = vectors.select(F.col("id").alias("b"), F.col("vector").alias("other"))
    return vectors.join(b, F.col("b") == F.col("id") + 1).select(F.col("id").alias("a"), "b", F.round(V.dot(F.col("vector"), F.col("other")), 6).alias("dot"))


@query("normalised_vectors", "SELECT id, round(list_sum(list_transform(vector::DOUBLE[], lambda x: x / 3)) / sqrt(list_dot_product(vector::DOUBLE[], vector::DOUBLE[])) * 3, 5) AS total FROM vectors")
def normalised_vectors(vectors):
    v = V.normalised(F.transform("vector", lambda x: x.cast("double") * 2))
    return vectors.select("id", F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("graph_levels", "SELECT id, least(5, length(regexp_extract(sha256(CAST(id AS VARCHAR)), '^(([0-9a-f][048c])*)', 1)) // 2) AS level FROM vectors")
def graph_levels(vectors):
    return vectors.select("id", V.graph_level(F.col("id").cast("string")).alias("level"))


@query("vector_top_k", f"WITH {SCORED} SELECT id, rank, round(score, 6) AS score FROM ranking WHERE rank < 100")
def vector_top_k(vectors):
    return Q.with_rank(Q.ranked(vectors, QUERY, 100)).select("id", "rank", F.round("score", 6).alias("score"))


TOP_10_EACH = "SELECT q.id AS query_id, v.id, row_number() OVER (PARTITION BY q.id ORDER BY list_dot_product(q.vector::DOUBLE[], v.vector::DOUBLE[]) DESC, v.id) - 1 AS rank, round(list_dot_product(q.vector::DOUBLE[], v.vector::DOUBLE[]), 6) AS score FROM vectors q, vectors v WHERE q.id % 20 = 0 QUALIFY rank < 10"


def built_index(vectors):
    """An index, published to a store of its own and read from there."""
    spark = vectors.sparkSession
    store = Snapshots(spark, shared_dir(spark, "vector-index"))
    vector_index.build(vectors.select("id", "vector"), store)
    return vector_index.VectorIndex(store)


@query("vectors_top_10_each", TOP_10_EACH)
def vectors_top_10_each(vectors):
    """Every vector whose id is divisible by 20 is a query against all vectors; the index is searched to the end."""
    found = built_index(vectors).search(vectors.where("id % 20 = 0"), 10, exact=True)
    return found.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query("vectors_ann_top_10_each")
def vectors_ann_top_10_each(vectors):
    """The same, of the most promising cells only: at least 0.9 of the true results (tested against the exact ones)."""
    found = built_index(vectors).search(vectors.where("id % 20 = 0"), 10)
    return found.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query("metadata_candidates", f"WITH {SCORED}, hits AS (SELECT r.* FROM ranking r JOIN source_rows s ON s.upstream_asset_id = CAST(r.id AS VARCHAR) WHERE s.visibility_status = 'active' AND {LIKE}) SELECT id, row_number() OVER (ORDER BY score DESC, captured_at DESC, source_key, id) - 1 AS rank FROM hits")
def metadata_candidates(vectors, source_rows):
    rows = source_rows.withColumn("id", F.col("upstream_asset_id").cast("bigint"))
    return Q.metadata_candidates(vectors, rows, "19", QUERY).select("id", "rank")


@query("metadata_promotion", f"WITH {SCORED}, hits AS (SELECT CAST(upstream_asset_id AS BIGINT) AS id FROM source_rows WHERE visibility_status = 'active' AND {LIKE}) SELECT id, row_number() OVER (ORDER BY CASE WHEN id IN (SELECT id FROM hits) THEN 0 ELSE 1 END, rank) - 1 AS rank FROM ranking WHERE rank < 200")
def metadata_promotion(vectors, source_rows):
    hits = Q.by_metadata(source_rows, "19").select(F.col("upstream_asset_id").cast("bigint").alias("id"))
    return Q.promoted(Q.with_rank(Q.ranked(vectors, QUERY, 200)), hits).select("id", "rank")


@query("diversified_ranking", f"""WITH RECURSIVE {SCORED}, head AS (SELECT id, CAST(rank AS INTEGER) AS rank, vector FROM ranking WHERE rank < 80),
  near AS (SELECT b.rank, coalesce(list(a.rank) FILTER (WHERE a.rank IS NOT NULL), []) AS before FROM head b LEFT JOIN head a ON a.rank < b.rank AND list_dot_product(a.vector::DOUBLE[], b.vector::DOUBLE[]) >= 0.86 GROUP BY b.rank),
  deal(rank, kept) AS (SELECT -1, CAST([] AS INTEGER[]) UNION ALL SELECT n.rank, CASE WHEN list_has_any(d.kept, n.before) THEN d.kept ELSE list_append(d.kept, n.rank) END FROM deal d JOIN near n ON n.rank = d.rank + 1),
  kept AS (SELECT unnest(kept) AS rank FROM (SELECT kept FROM deal ORDER BY rank DESC LIMIT 1))
  SELECT id, CAST(row_number() OVER (ORDER BY CASE WHEN rank IN (SELECT rank FROM kept) THEN 0 ELSE 1 END, rank) - 1 AS INTEGER) AS rank FROM head UNION ALL SELECT id, CAST(rank AS INTEGER) FROM ranking WHERE rank BETWEEN 80 AND 299""")
def diversified_ranking(vectors):
    return Q.diversified(Q.with_rank(Q.ranked(vectors, QUERY, 300)))


@query("resolved_page", f"WITH {SCORED}, firsts AS (SELECT *, row_number() OVER (PARTITION BY canonical_asset_id ORDER BY rank) AS n FROM ranking WHERE rank < 400) SELECT canonical_asset_id, id, rank FROM firsts WHERE n = 1 AND media_type = 'video' ORDER BY rank LIMIT 15 OFFSET 15")
def resolved_page(vectors):
    ranking = Q.with_rank(Q.ranked(vectors, QUERY, 400)).select("id", "rank", "score")
    r = resolve(SearchRequest(kind="search", text="x", mode="semantic", media_types=("video",), page=1, page_size=15))
    return Q.resolved(ranking, vectors.select("id", "canonical_asset_id", "media_type", "captured_at"), r).select("canonical_asset_id", "id", "rank")


@query("hybrid_search", f"WITH {CANON} SELECT canonical_asset_id FROM canon c WHERE EXISTS (SELECT 1 FROM linked l WHERE l.canonical_asset_id = c.canonical_asset_id AND l.visibility_status = 'active' AND lower(l.filename) LIKE '%img_1%') ORDER BY captured_at DESC, canonical_asset_id LIMIT 60")
def hybrid_search(source_rows):
    """Auto mode without an index: by filename."""
    r = resolve(SearchRequest(kind="search", text="IMG_1"), has_index=False)
    rows = C.with_canonical_ids(source_rows)
    from shoebox.operators.timeline import page

    return page(Q.by_filename(C.canonical_assets(rows), rows, r.text), r).select("canonical_asset_id")
