"""Text functions over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity, text
from .registry import query

STOPS = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
SQL_TOKENS = f"list_filter(regexp_extract_all(lower(text), '{text.TOKEN}'), lambda t: length(t) > 1 AND NOT list_contains([{STOPS}], t))"


@query("tokens_top", f"SELECT token, count(*) AS n FROM (SELECT unnest({SQL_TOKENS}) AS token FROM documents) GROUP BY 1 ORDER BY n DESC, token LIMIT 100")
def tokens_top(t):
    return text.token_rows(t("documents"), "text").groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(100)


@query("sparse_tf", f"SELECT item_id, token, round(1 + ln(count(*)), 6) AS tf FROM (SELECT item_id, unnest({SQL_TOKENS}) AS token FROM benchmark) GROUP BY 1, 2")
def sparse_tf(t):
    from ..operators.lexical import terms

    return terms(t("benchmark"), "item_id", "text").withColumn("tf", F.round("tf", 6))


@query(
    "idf_table",
    f"WITH w AS (SELECT DISTINCT doc_id, unnest({SQL_TOKENS}) AS token FROM documents), n AS (SELECT count(*) AS n FROM documents) SELECT token, count(*) AS df, round(ln((max(n) - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) AS idf FROM w, n GROUP BY 1",
)
def idf_table(t):
    from ..operators.lexical import idf, terms

    docs = t("documents")
    return idf(terms(docs, "doc_id", "text"), docs.agg(F.count("*").alias("n"))).withColumn("idf", F.round("idf", 6))


@query("clean_text", "SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), '\\s+', ' ', 'g')) AS cleaned FROM conversations")
def clean_text(t):
    return t("conversations").select("conv_id", "turn", text.clean_notebook_text(F.col("text")).alias("cleaned"))


@query(
    "clip_abstract",
    r"""WITH c AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS t FROM documents), p AS (SELECT doc_id, t, substr(t, 1, 120) AS cut, regexp_replace(regexp_extract(substr(t, 1, 120), '^(.*) [^ ]*$', 1), '[ ,;:]+$', '') AS back FROM c)
SELECT doc_id, CASE WHEN length(t) <= 120 THEN t WHEN back = '' THEN regexp_replace(cut, '[ ,;:]+$', '') || '…' ELSE back || '…' END AS abstract FROM p""",
)
def clip_abstract(t):
    return t("documents").select("doc_id", text.clip(F.col("text"), 120).alias("abstract"))


@query(
    "prose_flag",
    r"SELECT item_id, len(regexp_extract_all(text, '\b[A-Za-z][A-Za-z''-]*\b')) >= 6 AND length(regexp_replace(text, '[^\p{L}]', '', 'g')) >= 0.55 * length(regexp_replace(text, '\s', '', 'g')) AS prose FROM benchmark",
)
def prose_flag(t):
    return t("benchmark").select("item_id", text.looks_like_prose(F.col("text")).alias("prose"))


@query("terminal_punct", r"""SELECT doc_id, regexp_matches(rtrim(text), '[.!?]["''”’)\]}]*$') AS complete FROM documents""")
def terminal_punct(t):
    return t("documents").select("doc_id", text.ends_sentence(F.col("text")).alias("complete"))


_CT = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9_.-]+'), lambda t: length(t) > 2))"


@query(
    "lexical_support",
    f"WITH p AS (SELECT b.item_id, d.doc_id, {_CT.format('b.text')} AS s, {_CT.format('d.text')} AS q FROM benchmark b JOIN documents d ON d.doc_id = b.item_id * 11) SELECT item_id, doc_id, round(CASE WHEN len(s) = 0 THEN 0 ELSE len(list_intersect(s, q)) / len(s) END, 6) AS support FROM p",
)
def lexical_support(t):
    d = t("documents").select("doc_id", F.col("text").alias("quote"))
    return t("benchmark").join(d, F.expr("doc_id = item_id * 11")).select("item_id", "doc_id", F.round(text.support(F.col("text"), F.col("quote")), 6).alias("support"))


@query(
    "distinct_2",
    "WITH w AS (SELECT conv_id, turn, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM conversations), g AS (SELECT conv_id, turn, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w) SELECT round(count(DISTINCT g) / count(*), 6) AS distinct_2, count(*) AS n FROM g",
)
def distinct_2(t):
    w = F.split(text.collapse(F.col("text")), " ")
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.get("w", i - 1), F.get("w", i)))
    g = t("conversations").select(w.alias("w")).where(F.size("w") > 1).select(F.explode(grams).alias("g"))
    return g.groupBy("g").agg(F.count("*").alias("c")).agg(F.round(F.count("*") / F.sum("c"), 6).alias("distinct_2"), F.sum("c").alias("n"))


@query(
    "id_normalize",
    r"""WITH r AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://arxiv.org/abs/' || lpad(CAST(1000 + page_id AS VARCHAR), 4, '0') || '.' || lpad(CAST(page_id AS VARCHAR), 5, '0') || 'v2' WHEN 1 THEN ' hep-th/' || lpad(CAST(page_id AS VARCHAR), 7, '0') || ' ' WHEN 2 THEN 'http://export.arxiv.org/pdf/2101.' || lpad(CAST(page_id AS VARCHAR), 5, '0') || '.pdf?x=1' ELSE url END AS raw FROM pages)
SELECT page_id, CASE page_id % 4 WHEN 0 THEN lpad(CAST(1000 + page_id AS VARCHAR), 4, '0') || '.' || lpad(CAST(page_id AS VARCHAR), 5, '0') WHEN 1 THEN 'hep-th/' || lpad(CAST(page_id AS VARCHAR), 7, '0') WHEN 2 THEN '2101.' || lpad(CAST(page_id AS VARCHAR), 5, '0') END AS base_id, CASE WHEN page_id % 4 = 0 THEN 2 END AS version FROM r""",
)
def id_normalize(t):
    k = F.col("page_id")
    five = F.lpad(k.cast("string"), 5, "0")
    raw = (
        F.when(k % 4 == 0, F.concat(F.lit("https://arxiv.org/abs/"), F.lpad((1000 + k).cast("string"), 4, "0"), F.lit("."), five, F.lit("v2")))
        .when(k % 4 == 1, F.concat(F.lit(" hep-th/"), F.lpad(k.cast("string"), 7, "0"), F.lit(" ")))
        .when(k % 4 == 2, F.concat(F.lit("http://export.arxiv.org/pdf/2101."), five, F.lit(".pdf?x=1")))
        .otherwise(F.col("url"))
    )
    return t("pages").select("page_id", identity.paper_identity(raw).alias("i")).select("page_id", "i.base_id", "i.version")


@query("html_meta", r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<meta[^>]*>')) AS BIGINT) AS n_meta, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang FROM pages""")
def html_meta(t):
    h = F.col("html")
    return t("pages").select("page_id", F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count(h, F.lit("<meta[^>]*>")).cast("long").alias("n_meta"), F.regexp_extract(h, '<html lang="([a-z]+)"', 1).alias("lang"))


@query("token_estimate", "SELECT item_id, greatest(1, CAST(ceil(strlen(text) / 4) AS BIGINT)) AS tokens FROM benchmark")
def token_estimate(t):
    return t("benchmark").select("item_id", text.json_tokens(F.col("text")).alias("tokens"))


@query("composite_key", "SELECT doc_id, 'research_' || sha256(concat_ws(':', CAST(doc_id AS VARCHAR), lang, source)) AS key FROM documents")
def composite_key(t):
    return t("documents").select("doc_id", identity.composite_key("research_", F.col("doc_id").cast("string"), F.col("lang"), F.col("source")).alias("key"))


@query("evidence_ids", r"SELECT item_id, 'ev_' || substr(sha256('h:c1:' || CAST(item_id AS VARCHAR) || ':' || lower(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')))), 1, 24) AS evidence_id FROM benchmark")
def evidence_ids(t):
    return t("benchmark").select("item_id", identity.evidence_id(F.lit("h"), F.lit("c1"), F.col("item_id"), F.col("text")).alias("evidence_id"))


@query("file_stems", r"SELECT page_id, regexp_replace(string_split(url, '/')[-1], '(?i)\.(pdf|html)$', '') AS stem FROM pages")
def file_stems(t):
    return t("pages").select("page_id", identity.file_stem(F.col("url")).alias("stem"))


@query("chart_labels", "SELECT DISTINCT strftime(o_orderdate, '%b %Y') AS label FROM orders")
def chart_labels(t):
    return t("orders").select(F.date_format("o_orderdate", "MMM yyyy").alias("label")).distinct()


@query("derived_titles", "SELECT item_id, CASE WHEN length(trim(split_part(trim(text), '.', 1))) < 3 THEN 'Derived implementation idea' ELSE substr(trim(split_part(trim(text), '.', 1)), 1, 200) END AS title FROM benchmark")
def derived_titles(t):
    return t("benchmark").select("item_id", text.derived_title(F.col("text")).alias("title"))


@query("date_validity", "SELECT event_id, try_strptime(CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN 'yesterday' ELSE '' END, ['%Y-%m-%dT%H:%M:%SZ', '%Y-%m-%d']) IS NOT NULL AS valid FROM events")
def date_validity(t):
    from ..functions.validate import valid_publication_date

    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format("ts", "yyyy-MM-dd")).when(k == 2, "yesterday").otherwise("")
    return t("events").select("event_id", valid_publication_date(raw, F.current_timestamp()).alias("valid"))


_PAGE = r"""CASE WHEN (conv_id + turn) % 5 = 1 THEN text || chr(10) || ' References ' || chr(10) || 'a b' WHEN (conv_id + turn) % 7 = 3 THEN 'Appendix one' || chr(10) || text ELSE text END"""


@query(
    "strip_references",
    rf"""WITH p AS (SELECT conv_id, turn, text, {_PAGE} AS page, (conv_id + turn) % 5 = 1 AS h, (conv_id + turn) % 5 <> 1 AND (conv_id + turn) % 7 = 3 AS a FROM conversations),
s AS (SELECT *, CASE WHEN h THEN 1 WHEN a THEN 0 END AS d FROM p),
i AS (SELECT *, coalesce(last_value(d IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS inside FROM s)
SELECT conv_id, turn, CASE WHEN inside AND a THEN page WHEN inside THEN '' WHEN h THEN trim(text, chr(10) || ' ') ELSE page END AS page FROM i""",
)
def strip_references(t):
    k = F.col("conv_id") + F.col("turn")
    page = F.when(k % 5 == 1, F.concat("text", F.lit("\n References \na b"))).when(k % 7 == 3, F.concat(F.lit("Appendix one\n"), "text")).otherwise(F.col("text"))
    return text.strip_references(t("conversations").select("conv_id", "turn", page.alias("page")), "conv_id", "turn", "page").withColumn("page", F.when(k % 5 == 1, F.trim(F.regexp_replace("page", r"^[ \n]+|[ \n]+$", ""))).otherwise(F.col("page")))


@query(
    "char_windows",
    "SELECT doc_id, CAST(i AS INTEGER) AS n, CAST(i * 800 AS INTEGER) AS start, substr(text, i * 800 + 1, 1000) AS piece FROM (SELECT doc_id, text, unnest(range(CAST(greatest(1, ceil((length(text) - 200) / 800)) AS BIGINT))) AS i FROM documents WHERE length(text) > 0)",
)
def char_windows(t):
    return text.char_windows(t("documents"), "doc_id", "text")


@query("first_identities", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE '2101.' || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') END AS base_id, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE 'https://arxiv.org/abs/2101.' || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') || CASE WHEN o_orderkey % 3 = 0 THEN 'v2' ELSE '' END END AS abs_url FROM orders")
def first_identities(t):
    k = F.col("o_orderkey")
    five = F.concat(F.lit("2101."), F.lpad((k % 100000).cast("string"), 5, "0"))
    arxiv_id = F.when(k % 3 == 0, F.concat(five, F.lit("v2"))).when(k % 3 == 1, F.lit("  "))
    fallback = F.when(k % 3 == 1, F.concat(F.lit("https://arxiv.org/pdf/"), five, F.lit(".pdf"))).otherwise("not an id")
    i = identity.first_identity(arxiv_id, F.lit(""), fallback)
    return t("orders").select("o_orderkey", i.alias("i")).select("o_orderkey", "i.base_id", identity.canonical_urls(F.col("i"))["abs_url"].alias("abs_url"))


@query("alias_lookup", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 0")
def alias_lookup(t):
    """Papers found by whatever form of their id they are asked for: a join on the normal form."""
    o = t("orders").where("o_orderkey % 2 = 0")
    five = F.concat(F.lit("21"), F.lpad(F.floor(F.col("o_orderkey") / 100000 + 1).cast("string"), 2, "0"), F.lit("."), F.lpad((F.col("o_orderkey") % 100000).cast("string"), 5, "0"))
    papers = o.select("o_orderkey", "o_custkey", identity.paper_identity(five)["base_id"].alias("base_id"))
    asked = o.select(F.concat(F.when(F.col("o_orderkey") % 4 == 0, "https://arxiv.org/abs/").otherwise("http://export.arxiv.org/pdf/"), five, F.when(F.col("o_orderkey") % 4 == 0, "v3").otherwise(".pdf")).alias("raw"))
    return asked.select(identity.paper_identity(F.col("raw"))["base_id"].alias("base_id")).join(papers, "base_id").select("o_orderkey", "o_custkey")


@query("safe_paths", r"SELECT DISTINCT p_type, regexp_replace(regexp_replace(p_brand, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS folder FROM part")
def safe_paths(t):
    return t("part").select("p_type", identity.safe_path(F.col("p_brand")).alias("folder")).distinct()


@query("author_lists", "SELECT p_partkey, string_split(p_name, ' ') AS authors FROM part")
def author_lists(t):
    from ..functions.arrays import authors

    return t("part").select("p_partkey", authors(F.regexp_replace("p_name", " ", " and ")).alias("authors"))


@query("latest_times", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 2 DAY ELSE o_orderdate END AS latest FROM orders")
def latest_times(t):
    from ..functions.arrays import latest

    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    later = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(F.col("o_orderdate") + F.expr("interval 2 day"), "yyyy-MM-dd'T'HH:mm:ss")).otherwise("never")
    return t("orders").select("o_orderkey", latest(iso, later, F.lit(None).cast("string")).cast("timestamp_ntz").alias("latest"))


@query("unique_strings", "SELECT p_partkey, list_filter([p_type, p_brand], lambda x: x <> '') AS names FROM part")
def unique_strings(t):
    return t("part").select("p_partkey", text.unique_clean(F.array(F.concat(F.lit(" "), "p_type"), F.lit(" "), "p_brand", "p_type")).alias("names"))


@query("concept_lists", "SELECT p_partkey, list_filter([p_type, p_brand], lambda x: length(x) > 2) AS concepts FROM part")
def concept_lists(t):
    return t("part").select("p_partkey", text.clean_concepts(F.array("p_type", F.lit("{json"), F.lit("ab"), F.concat(F.lit(" "), "p_brand"), F.lit("see page_num 3"))).alias("concepts"))


@query("topic_texts", r"SELECT page_id, trim(regexp_replace(regexp_replace(lower(regexp_replace(url, '[^/]*$', '')), '(https?://|www\.)[^ \n\t]+', ' ', 'g') || ' topic - one, two.', '\s+', ' ', 'g')) AS cleaned FROM pages")
def topic_texts(t):
    return t("pages").select("page_id", text.clean_topic_text(F.concat(F.regexp_replace("url", "[^/]*$", ""), F.lit(" Topic - one, two. (a@b.org)"))).alias("cleaned"))


@query("meta_contents", "SELECT page_id, CAST(len(regexp_extract_all(html, '<meta[^>]*name=\"description[a-z_]*\"[^>]*content=\"([^\"]*)\"')) AS BIGINT) AS n FROM pages")
def meta_contents(t):
    return t("pages").select("page_id", F.size(text.meta_tags(F.col("html"), "description")).cast("long").alias("n"))


@query("paper_schema_errors", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'missing title; unreadable published' WHEN o_orderkey % 6 = 1 THEN 'no authors' ELSE '' END AS errors FROM orders")
def paper_schema_errors(t):
    from ..functions.validate import paper_errors

    k = F.col("o_orderkey")
    paper = t("orders").select(
        "o_orderkey", k.cast("string").alias("id"), F.when(k % 4 != 0, "title").otherwise(" ").alias("title"), F.lit("s").alias("summary"), F.when(k % 4 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon").alias("published"),
        F.when(k % 6 == 1, F.when(k % 4 != 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a")))).otherwise(F.array(F.lit("a"))).alias("authors"), F.array("o_orderstatus").alias("categories"),
    )
    return paper.select("o_orderkey", F.array_join(paper_errors(), "; ").alias("errors"))
