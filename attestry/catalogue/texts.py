"""Text functions over parts, pages and documents: names, credits, dates, company lines, ids, URLs, HTML heads, wiki markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import values as V
from ..functions import wikitext as K
from ..sources.readers import table
from ._registry import query


@query("""SELECT p_partkey, trim(regexp_replace(trim(regexp_replace(lower('The ' || p_name || ' -- (' || p_brand || ')!'), '[^0-9a-z]+', ' ', 'g')), '^(the|a|an)\\s+', '')) AS name FROM part""".replace("\\\\", "\\"))
def name_normalize(spark, d):
    return table(spark, d, "part").select("p_partkey", N.collision_form(F.concat(F.lit("The "), "p_name", F.lit(" -- ("), "p_brand", F.lit(")!"))).alias("name"))


@query("""SELECT p_partkey, p_name || '; ' || p_brand AS names, CASE WHEN p_size % 2 = 0 THEN p_name || ', ' || p_brand ELSE p_name END AS shown FROM part""")
def credit_split(spark, d):
    """Credit lines with parentheses and placeholders; and shortened lists of names."""
    p = table(spark, d, "part")
    names = N.credit_names(F.concat("p_name", F.lit(" (art), unknown, N/A,, "), "p_brand", F.lit(" (music)")))
    shown = N.names_shown(F.when(F.col("p_size") % 2 == 0, F.array("p_name", "p_brand")).otherwise(F.array("p_name")), 2)
    return p.select("p_partkey", F.array_join(names, "; ").alias("names"), shown.alias("shown"))


@query("""SELECT o_orderkey, year(o_orderdate)::INT AS year, CASE WHEN month(o_orderdate) = 1 AND day(o_orderdate) = 1 THEN NULL ELSE month(o_orderdate)::INT END AS month,
  year(o_orderdate)::INT AS precise_year, CASE WHEN o_orderkey % 3 < 2 THEN month(o_orderdate)::INT END AS precise_month, CASE WHEN o_orderkey % 3 < 1 THEN day(o_orderdate)::INT END AS precise_day FROM orders""")
def date_parse(spark, d):
    o = table(spark, d, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    plain = V.dated_or_year(F.concat(day, F.lit("T00:00:00")))
    fine = V.precise_date(F.concat(F.lit("+"), day, F.lit("T00:00:00Z")), (F.lit(V.DAY) - F.col("o_orderkey") % 3).cast("int"))
    return o.select("o_orderkey", plain["year"].alias("year"), plain["month"].alias("month"), fine["year"].alias("precise_year"), fine["month"].alias("precise_month"), fine["day"].alias("precise_day"))


@query("""SELECT s_suppkey, s_name AS company_name, CASE WHEN s_suppkey % 2 = 0 THEN n_name ELSE '' END AS trade_name, CASE WHEN s_suppkey % 3 = 0 THEN '1977-1983' ELSE '' END AS years_active, 'Paris, ' || n_name AS location
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def company_lines(spark, d):
    n = table(spark, d, "nation")
    s = table(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    even, third = F.col("s_suppkey") % 2 == 0, F.col("s_suppkey") % 3 == 0
    line = F.concat("s_name", F.lit(", of Paris, "), "n_name", F.when(third, " (1977-1983)").otherwise(""), F.when(even, F.concat(F.lit(" [Trade Name: "), "n_name", F.lit("]"))).otherwise(""))
    return s.select("s_suppkey", V.company_line(line).alias("x")).select("s_suppkey", "x.*")


@query("""SELECT page_id, regexp_extract(lower(url), '^https?://(?:www\\.)?([^/:?#]+)', 1) AS host, 'url' AS kind, CASE WHEN page_id % 2 = 0 THEN lpad(page_id::VARCHAR, 9, '0') || 'X' END AS isbn FROM pages""".replace("\\\\", "\\"))
def url_recognize(spark, d):
    code = F.when(F.col("page_id") % 2 == 0, F.concat_ws("-", F.lpad(F.col("page_id").cast("string"), 9, "0"), F.lit("x")))
    return table(spark, d, "pages").select("page_id", V.host(F.col("url")).alias("host"), V.evidence_kind(F.col("url")).alias("kind"), V.isbn(code).alias("isbn"))


@query("""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, len(list_distinct(regexp_extract_all(html, '(?i)<img[^>]*\\bsrc=["'']([^"'']+)["'']', 1)))::INT AS images FROM pages""".replace("\\\\", "\\"))
def html_meta(spark, d):
    return table(spark, d, "pages").select("page_id", V.head(F.col("html"))["title"].alias("title"), F.size(V.image_sources(F.col("html"))).alias("images"))


@query("""SELECT o_orderkey, year(o_orderdate)::INT AS year FROM orders""")
def year_in_text(spark, d):
    return table(spark, d, "orders").select("o_orderkey", V.year_in(F.concat(F.lit("no 12345, made in "), F.year("o_orderdate").cast("string"), F.lit("."))).alias("year"))


@query("""SELECT p_partkey, replace(p_name, ' ', '-') || '-1' AS slug, regexp_replace(replace(lower(p_name), ' ', ''), 's$', '') AS alias, string_split(p_name, ' ')[-1] AS last_name, lower(p_name) AS bare FROM part""")
def name_forms(spark, d):
    p, name = table(spark, d, "part"), F.col("p_name")
    return p.select("p_partkey", N.slug(F.concat(name, F.lit(" -- 1!"))).alias("slug"), N.alias_form(name).alias("alias"), N.last_name(name).alias("last_name"), N.without_suffixes(F.concat(name, F.lit(", Inc. Ltd"))).alias("bare"))


@query("""SELECT p_partkey, 'x' || p_size AS designer, p_brand AS brand, 'red ball' AS rest FROM part""")
def wiki_fields(spark, d):
    """Template fields with nested templates and links, and the text outside templates."""
    p = table(spark, d, "part")
    page = F.concat(F.lit("{{Infobox thing|designer=x"), F.col("p_size").cast("string"), F.lit("|note={{small|a|b}}|brand="), "p_brand", F.lit("}}red {{cite|1}}ball"))
    fields = K.template_fields(page, "Infobox")
    return p.select("p_partkey", fields["designer"].alias("designer"), fields["brand"].alias("brand"), K.without_templates(page).alias("rest"))


@query("""SELECT p_partkey, 'Art:' || p_name || ',Art:' || p_brand || ',Music:Ann B' AS credits, 'title:' || p_partkey || ',person:ann' AS links FROM part""")
def wiki_credits(spark, d):
    p = table(spark, d, "part")
    credits = K.labelled_credits(F.concat(F.lit("'''Art''': "), "p_name", F.lit(", "), "p_brand", F.lit("<br/>'''Music:''' [[person:ann|Ann B]]")))
    links = K.link_targets(F.concat(F.lit("see [[title:"), F.col("p_partkey").cast("string"), F.lit("]] and [[person:ann|Ann]], [[person:ann]]")))
    return p.select(
        "p_partkey", F.array_join(F.transform(credits, lambda x: F.concat_ws(":", x["role"], x["name"])), ",").alias("credits"), F.array_join(F.transform(links, lambda x: F.concat_ws(":", x["type"], x["ref"])), ",").alias("links")
    )


@query("""SELECT doc_id, contains(coalesce(text, ''), chr(65533)) AS garbled FROM documents WHERE regexp_full_match(coalesce(text, ''), '[\\x00-\\x7F\\x{FFFD}]*')""".replace("\\\\", "\\"))
def garbled_text(spark, d):
    """Only the ASCII and U+FFFD texts, of which SQL can tell; :func:`garbled_documents` is the whole job."""
    rows = table(spark, d, "documents").filter(F.coalesce("text", F.lit("")).rlike(r"^[\x00-\x7F\x{FFFD}]*\z"))
    return rows.select("doc_id", V.garbled(F.col("text")).alias("garbled"))


@query()
def garbled_documents(spark, d):
    """Every document. SQL has no cp1252 round trip; the tests hold it against brute force."""
    return table(spark, d, "documents").select("doc_id", V.garbled(F.col("text")).alias("garbled"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'solid-state' ELSE '' END AS technology, coalesce(CASE WHEN c_custkey % 2 = 0 THEN '1980-1985' ELSE '1980' END, '') AS years,
  CASE WHEN length(c_name) > 10 THEN left(c_name, 10) || '…' ELSE c_name END AS excerpt, 'G' || c_custkey AS id_group, 'G' || c_custkey || '-M1' AS id_parent FROM customer""")
def labels_and_ids(spark, d):
    c, key = table(spark, d, "customer"), F.col("c_custkey")
    id_ = F.concat(F.lit("G"), key.cast("string"), F.lit("-M1-A2"))
    years = V.years_label(F.lit(1980), F.when(key % 2 == 0, 1985).otherwise(1980))
    return c.select("c_custkey", V.mapped(F.when(key % 3 == 0, " SS").otherwise("?"), V.TECHNOLOGY).alias("technology"), years.alias("years"), V.excerpt(F.col("c_name"), 10).alias("excerpt"), V.group_of(id_).alias("id_group"), V.parent_of(id_).alias("id_parent"))
