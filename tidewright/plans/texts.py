"""Text, links, similarity, search and vectors on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import links, text
from tidewright.operators import graph, search, similarity, stories, vectors
from tidewright.plans.base import Registry, table
from tidewright.session import materialise
from tidewright.sources import files

R = Registry()
add = R.add

_SLUG = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@add(f"SELECT p_partkey, {_SLUG.format('p_name')} AS slug, {_SLUG.format('p_brand')} AS brand_slug FROM part")
def slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"), text.slug(F.col("p_brand")).alias("brand_slug"))


@add("""SELECT n_nationkey, 'P' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS p_code, 'N.' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS n_code, NULL::VARCHAR AS none FROM nation""")
def seat_code(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey").cast("string")
    rows = table(spark, d, "nation")
    return rows.select("n_nationkey", text.seat_code(F.concat(F.lit(" p. "), k)).alias("p_code"), text.seat_code(F.concat(F.lit("n"), k)).alias("n_code"), text.seat_code(F.concat(F.lit("x"), k)).alias("none"))


_TOKENS = "list_sort(list_distinct(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: length(w) >= {1})))"


@add(f"SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {_TOKENS.format('text', 4)} AS t FROM documents)")
def token_sets(spark: SparkSession, d: str) -> DataFrame:
    t = text.tokens(F.col("text"), 4)
    return table(spark, d, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@add("""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)license|copyright') THEN 'legal' WHEN regexp_matches(text, '(?i)token|secret|password') THEN 'secret' WHEN regexp_matches(text, '[|]') THEN 'table' ELSE NULL END AS theme FROM documents""")
def theme_classify(spark: SparkSession, d: str) -> DataFrame:
    rules = [("legal", "(?i)license|copyright"), ("secret", "(?i)token|secret|password"), ("table", "[|]")]
    return table(spark, d, "documents").select("doc_id", text.first_match(F.col("text"), rules).alias("theme"))


@add("""SELECT p_type, CASE WHEN contains(lower(p_name), 'ring') OR contains(lower(p_name), 'gear') THEN 'signal' WHEN contains(lower(p_name), 'red') THEN 'watch' ELSE 'noise' END AS triage, count(*) AS n FROM part GROUP BY 1, 2""")
def signal_triage(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("p_name")
    kind = F.when(text.any_keyword(name, ["ring", "gear"]), "signal").when(text.any_keyword(name, ["red"]), "watch").otherwise("noise")
    return table(spark, d, "part").groupBy("p_type", kind.alias("triage")).agg(F.count("*").alias("n"))


@add()
def type_classify_negation(spark: SparkSession, d: str) -> DataFrame:
    """First rule that matches without a negation shortly before (Java regular expressions with look-back)."""
    rules = [("secret", r"(?i)\btoken\b"), ("insult", r"(?i)\b(?:idiot|moron|clown)\b"), ("statement", r"(?i)\bthat\b")]
    return table(spark, d, "documents").select("doc_id", text.first_match_unless(F.col("text"), rules, r"(?i)\b(?:not|no|of)\b").alias("kind"))


@add()
def entity_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Longest dictionary phrases in part names and documents' texts, at word boundaries, without overlap."""
    needles = [("of the", "of_the"), ("the", "the"), ("license", "license"), ("of", "of"), ("red widget", "red_widget"), ("widget", "widget")]
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(table(spark, d, "part").select((-F.col("p_partkey") - 1).alias("id"), F.col("p_name").alias("text")))
    return stories.longest_matches(rows, "id", "text", needles).groupBy("id", "name").agg(F.count("*").alias("n"), F.min("start").alias("first_at"))


_FORM = "replace(replace(url_encode(url_decode(replace({0}, '+', ' '))), '%20', '+'), '*', '%2A')"


@add(rf"""WITH a AS (SELECT page_id, regexp_replace(replace(url, '&amp;', '&'), '#.*$', '') AS u FROM pages), b AS (SELECT page_id, regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1) AS head, u FROM a),
c AS (SELECT page_id, lower(head) AS head, regexp_extract(substr(u, length(head) + 1), '^([^?]*)', 1) AS path, list_filter(string_split(regexp_extract(substr(u, length(head) + 1), '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(utm_[^=]*|fbclid)(=|$)')) AS q FROM b)
SELECT page_id, head || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(list_transform(q, lambda x: {_FORM.format("regexp_extract(x, '^([^=]*)', 1)")} || '=' || {_FORM.format("regexp_replace(x, '^[^=]*=?', '')")}), '&') ELSE '' END AS link FROM c""")
def normalize_link(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", links.normalize_link(F.col("url")).alias("link"))


@add(r"""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) AS host FROM pages), p AS (SELECT * FROM (VALUES ('example.com', 'Example'), ('example.net', 'Network'), ('blog.ththan.example.net', 'Blog')) v(domain, publisher))
SELECT page_id, host, arg_max(publisher, length(domain)) AS publisher FROM h LEFT JOIN p ON host = domain OR ends_with(host, '.' || domain) GROUP BY page_id, host""")
def url_publisher(spark: SparkSession, d: str) -> DataFrame:
    """The longest known domain that the host ends in: suffixes of the host are exploded and equi-joined."""
    known = spark.createDataFrame([("example.com", "Example"), ("example.net", "Network"), ("blog.ththan.example.net", "Blog")], "domain string, publisher string")
    rows = table(spark, d, "pages").select("page_id", links.host(F.col("url")).alias("host"))
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hits = rows.select("page_id", F.explode(suffixes).alias("domain")).join(F.broadcast(known), "domain")
    best = hits.groupBy("page_id").agg(F.max_by("publisher", F.length("domain")).alias("publisher"))
    return rows.join(best, "page_id", "left").select("page_id", "host", "publisher")


@add(r"""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS found FROM orders WHERE o_orderkey % 3 < 2 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 3 = 2""")
def url_date(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    path = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "/yyyy/MM/dd/")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "/'news'-yyyy-MM-dd'.html'")).otherwise(F.lit("/page/17"))
    return o.select("o_orderkey", links.url_date(F.concat(F.lit("https://x.example.com"), path)).alias("found"))


@add("SELECT doc_id, 'ev' || substr(sha256(text), 1, 16) AS evidence_id, 'jg' || substr(sha256(source || lang || CAST(doc_id AS VARCHAR)), 1, 12) AS judgment_id FROM documents")
def hash_ids(spark: SparkSession, d: str) -> DataFrame:
    basis = F.concat("source", "lang", F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", links.short_id("ev", F.col("text")).alias("evidence_id"), links.short_id("jg", basis, 12).alias("judgment_id"))


@add(r"""SELECT page_id, len(a) AS n_links, a[1] AS first_link FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS a FROM pages)""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return table(spark, d, "pages").select("page_id", found.alias("a")).select("page_id", F.size("a").cast("long").alias("n_links"), F.get("a", F.lit(0)).alias("first_link"))


@add(r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS target FROM pages), p AS (SELECT DISTINCT '/' || regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) AS path FROM pages)
SELECT page_id, target, count(*) AS n FROM l WHERE target LIKE '/%' AND target NOT IN (SELECT path FROM p) GROUP BY 1, 2""")
def broken_links(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    found = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("target")).where(F.col("target").startswith("/"))
    known = pages.select(F.concat(F.lit("/"), F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1)).alias("target")).distinct()
    return found.join(known, "target", "left_anti").groupBy("page_id", "target").agg(F.count("*").alias("n"))


@add("""SELECT title, link, published FROM (SELECT 'Order ' || CAST(o_orderkey AS VARCHAR) AS title, 'https://x.example.com/' || CAST(o_orderkey AS VARCHAR) AS link, strftime(o_orderdate, '%Y-%m-%d') AS published FROM orders)""")
def feed_items(spark: SparkSession, d: str) -> DataFrame:
    """RSS written from orders and parsed again."""
    o = table(spark, d, "orders")
    key = F.col("o_orderkey").cast("string")
    xml = F.concat(F.lit("<rss><channel><item><title><![CDATA[Order "), key, F.lit("]]></title><link>https://x.example.com/"), key, F.lit("</link><pubDate>"), F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate></item></channel></rss>"))
    items = o.select(F.inline(files.feed_items(xml)))
    return items.select("title", "link", files.published_date(F.col("published")).alias("published"))


_DOCTOK = f"SELECT doc_id, {_TOKENS.format('text', 4)} AS t FROM documents"


def _signatures(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.tokens(F.col("text"), 4).alias("t"))


@add(f"""WITH d AS ({_DOCTOK}), f AS (SELECT token, count(*) AS df FROM (SELECT unnest(t) AS token FROM d) GROUP BY 1) SELECT token, df, round(ln(((SELECT count(*) FROM d) + 1.0) / (df + 1.0)) + 1e-9, 9) AS weight FROM f""")
def idf_weights(spark: SparkSession, d: str) -> DataFrame:
    rows = _signatures(spark, d)
    weights = similarity.idf(similarity.document_frequency(rows, "doc_id", "t"), rows.agg(F.count("*").alias("n")))
    return weights.select("token", "df", F.round("weight", 9).alias("weight"))


_JACCARD = f"""WITH d AS ({_DOCTOK}), e AS (SELECT doc_id, len(t) AS n, unnest(t) AS token FROM d), p AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS shared FROM e x JOIN e y ON x.token = y.token AND x.doc_id < y.doc_id GROUP BY 1, 2)
SELECT a, b, shared, na AS size_a, nb AS size_b FROM p WHERE shared >= 0.6 * (na + nb - shared) - 1e-9"""


@add(_JACCARD)
def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    return similarity.jaccard_pairs(_signatures(spark, d), "doc_id", "t", 0.6)


@add(f"""WITH d AS ({_DOCTOK}), e AS (SELECT doc_id, unnest(t) AS token FROM d), f AS (SELECT token, ln(((SELECT count(*) FROM d) + 1.0) / (count(*) + 1.0)) + 1e-9 AS w FROM e GROUP BY 1), s AS (SELECT doc_id, sum(w) AS total FROM e JOIN f USING (token) GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(w) AS common FROM e x JOIN e y ON x.token = y.token AND x.doc_id < y.doc_id JOIN f ON f.token = x.token GROUP BY 1, 2) SELECT a, b, round(common / (sa.total + sb.total - common), 6) AS score FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE common / (sa.total + sb.total - common) >= 0.6""")
def weighted_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = _signatures(spark, d)
    weights = similarity.idf(similarity.document_frequency(rows, "doc_id", "t"), rows.agg(F.count("*").alias("n")))
    return similarity.weighted_jaccard_pairs(rows, "doc_id", "t", weights, 0.6).select("a", "b", F.round("score", 6).alias("score"))


@add("""WITH e AS (SELECT p_partkey, p_brand, p_type, unnest(list_distinct(string_split(p_name, ' '))) AS token FROM part) SELECT x.p_partkey AS a, y.p_partkey AS b, count(*) AS shared FROM e x JOIN e y ON x.p_brand = y.p_brand AND x.p_type = y.p_type AND x.token = y.token AND x.p_partkey < y.p_partkey GROUP BY 1, 2 HAVING count(*) >= 2""")
def near_dup_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.concat("p_brand", F.lit("|"), "p_type").alias("block"), F.split("p_name", " ").alias("t"))
    return similarity.shared_token_pairs(rows, "p_partkey", "t", 2, "block")


@add(f"""WITH RECURSIVE l AS ({_JACCARD}), e AS (SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l), r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y) SELECT x AS doc_id, min(y) AS component FROM r GROUP BY x""")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of the classes of equal sets; a class is named by its smallest document, so a component is too."""
    pairs, members = similarity.similar_classes(_signatures(spark, d), "doc_id", "t", 0.6)
    links = pairs.where("ca != cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    found = graph.connected_components(members.select("class").distinct(), "class", links)
    named = members.join(found, "class").select(F.col("id").alias("doc_id"), "component")
    return table(spark, d, "documents").select("doc_id").join(named, "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))


@add()
def greedy_feed(spark: SparkSession, d: str) -> DataFrame:
    """Each brand's feed of part names: the feature is the cap of 120 and the quota a type."""
    rows = table(spark, d, "part").select("p_brand", "p_size", "p_partkey", F.col("p_type").alias("source"), F.split("p_name", " ").alias("tokens"))
    return stories.greedy_feed(rows, "p_brand", "p_size", "tokens", "p_partkey", per_source=5, shared=2)


@add()
def greedy_consolidate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_brand", "p_partkey", F.array_append(F.split("p_name", " "), F.col("p_type")).alias("tokens"), (F.col("p_size") % 7 + 1).alias("size"))
    return stories.consolidate(rows, "p_brand", "p_partkey", "tokens", "size")


_WORDS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


@add(f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS al FROM d), h AS (SELECT * FROM d WHERE list_contains(w, 'the') AND list_contains(w, 'thnd')),
f AS (SELECT 'the' AS token, count_if(list_contains(w, 'the')) AS df FROM d UNION ALL SELECT 'thnd', count_if(list_contains(w, 'thnd')) FROM d), tf AS (SELECT doc_id, len(w) AS l, token, df, len(list_filter(w, lambda x: x = token)) AS tf FROM h, f)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / al))), 6) AS score FROM tf, s GROUP BY doc_id""")
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(table(spark, d, "documents"), "doc_id", "text", ["the", "thnd"]).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@add(f"""WITH d AS (SELECT doc_id, ' ' || array_to_string({_WORDS}, ' ') || ' ' AS t FROM documents) SELECT doc_id FROM d WHERE (contains(t, ' of the ') OR contains(t, ' thn')) AND NOT contains(t, ' was ')""")
def boolean_search(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(search.match(F.col("text"), '("of the" OR thn*) AND NOT was')).select("doc_id")


_FOLDED = r"list_filter(string_split_regex(strip_accents(lower(text || ' ' || lang)), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


@add(f"""WITH d AS (SELECT doc_id, lang, {_FOLDED} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS al FROM d),
t AS (SELECT doc_id, lang, len(w) AS l, len(list_filter(w, lambda x: x = 'the')) AS t0, len(list_filter(w, lambda x: starts_with(x, 'en'))) AS t1 FROM d), f AS (SELECT count_if(t0 > 0) AS f0, count_if(t1 > 0) AS f1 FROM t),
r AS (SELECT doc_id, lang, ln(1 + (n - f0 + 0.5) / (f0 + 0.5)) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * l / al)) + ln(1 + (n - f1 + 0.5) / (f1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * l / al)) AS score FROM t, f, s WHERE t0 > 0 AND t1 > 0)
SELECT doc_id, round(score, 6) AS score FROM r WHERE lang = 'en' ORDER BY round(score, 6) DESC, doc_id LIMIT 25""")
def indexed_search(spark: SparkSession, d: str) -> DataFrame:
    """Search with filters over an index that is written once; the limit is the command's."""
    docs = table(spark, d, "documents")
    index = materialise(search.text_index(docs, "doc_id", ["text", "lang"]).repartition("token"), "text-index")
    hits = search.index_search(index, ["THÉ", "en"], search.index_totals(index, docs.count()), prefix=True)
    rows = hits.join(docs.where("lang = 'en'").select(F.col("doc_id").alias("id")), "id", "left_semi")
    return rows.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(25)


@add("""SELECT c_custkey AS id FROM customer WHERE list_contains(string_split(lower(c_mktsegment), ' '), 'building') AND regexp_matches(lower(c_name), '\\b00000001[0-9]*')""")
def entity_index_search(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    index = materialise(search.text_index(c, "c_custkey", ["c_name", "c_mktsegment"]), "entity-index")
    return search.index_search(index, ["Building", "00000001"], search.index_totals(index, c.count()), prefix=True).select("id")


@add()
def snippet(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part")
    said = F.concat_ws(" ", F.lit("A part of type"), "p_type", F.lit("by"), "p_brand", F.lit("is a"), "p_name", F.lit("in size"), F.col("p_size").cast("string"), F.lit("and nothing else that we know of"))
    return rows.select("p_partkey", search.snippet(said, ["ring", "red", "size"]).alias("snippet"))


_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


@add(f"""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 7) SELECT vec_id AS id, round({_DOT.format('embedding', 'q')} / (sqrt({_DOT.format('embedding', 'embedding')}) * sqrt({_DOT.format('q', 'q')})), 6) AS score FROM embeddings, q ORDER BY {_DOT.format('embedding', 'q')} / (sqrt({_DOT.format('embedding', 'embedding')}) * sqrt({_DOT.format('q', 'q')})) DESC, vec_id LIMIT 10""")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return vectors.top_k(e, "vec_id", "embedding", e.where("vec_id = 7").select(F.col("embedding").alias("q")), 10).select("id", F.round("score", 6).alias("score"))


@add(f"""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id AS id, {_DOT.format('embedding', 'q')} / (sqrt({_DOT.format('embedding', 'embedding')}) * sqrt({_DOT.format('q', 'q')})) AS score FROM embeddings, q)
SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5""")
def cosine_topk_multi(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return vectors.top_k_each(e, "vec_id", "embedding", asked, 5).select("query_id", "id", "rank")


@add(f"""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 3), s AS (SELECT p_partkey, {_DOT.format('embedding', 'q')} / (sqrt({_DOT.format('embedding', 'embedding')}) * sqrt({_DOT.format('q', 'q')})) AS cosine, (CAST(list_contains(string_split(p_name, ' '), 'red') AS INT) + CAST(list_contains(string_split(p_name, ' '), 'ring') AS INT)) / 2.0 * 0.7 + (CAST(lower(p_type) = 'red' AS INT) + CAST(lower(p_type) = 'economy' AS INT)) / 2.0 * 0.0 AS lexical FROM part JOIN embeddings ON vec_id = p_partkey, q)
SELECT p_partkey, round(lexical * 0.6 + cosine * 0.4, 6) AS score FROM s""")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 3").select(F.col("embedding").alias("q"))
    rows = table(spark, d, "part").join(e, F.col("vec_id") == F.col("p_partkey")).crossJoin(F.broadcast(q))
    lexical = search.lexical_overlap([(F.split("p_name", " "), 0.7)], ["red", "ring"])
    return rows.select("p_partkey", F.round(search.hybrid(lexical, vectors.cosine(F.col("embedding"), F.col("q"))), 6).alias("score"))


@add()
def pca_map(spark: SparkSession, d: str) -> DataFrame:
    return vectors.pca_2d(table(spark, d, "embeddings"), "vec_id", "embedding")


@add()
def hashing_embeddings(spark: SparkSession, d: str) -> DataFrame:
    both = F.transform(F.array(vectors.hashing_embedder(F.col("p_name"), 32)), lambda v: F.struct(v.alias("v"), F.round(vectors.norm(v), 6).alias("length")))
    return table(spark, d, "part").select("p_partkey", F.inline(both))


@add(r"""WITH s AS (SELECT o_orderkey, 'Seat P' || lpad(CAST(o_orderkey % 222 + 1 AS VARCHAR), 3, '0') AS seat, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(o_custkey AS VARCHAR) AS num FROM orders)
SELECT o_orderkey, array_to_string(list_sort(list_distinct([seat[6:], day, num])), ',') AS tokens FROM s""")
def fact_tokens(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    said = F.concat(F.lit("Seat P"), F.lpad((F.col("o_orderkey") % 222 + 1).cast("string"), 3, "0"), F.lit(" on "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" counted "), F.col("o_custkey").cast("string"), F.lit(" votes"))
    return o.select("o_orderkey", F.array_join(text.fact_tokens(said), ",").alias("tokens"))
