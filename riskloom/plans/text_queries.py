"""Section G (text part): cleaning, counts, keywords, sections and tone."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import text as tx
from riskloom.functions import tone
from riskloom.functions.series import SYMBOL_DAY
from riskloom.operators import indicators as ind
from riskloom.plans.fixtures import (
    CORPUS_NEGATIVE, CORPUS_POSITIVE, filing_sections, filings, last, news, r, rnd, scored_filings, scored_news, sql, sql_clean, sql_compound,
    sql_label, table,
)
from riskloom.plans.registry import query


@query("g1_clean_text", f"SELECT doc_id, {sql_clean('text')} AS clean FROM documents")
def g1(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("clean"))


def _sql_filing(t: str) -> str:
    e = sql_clean(t)
    for p in tx.FILING_ARTEFACTS:
        e = f"regexp_replace({e}, '{p}', ' ', 'gi')"
    return f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"


_MARKED = "'Form 10-K page 12 ... table of contents Item 7a. ' || html || ' --- Pursuant to Section 13'"


@query("g2_clean_filing_text", f"SELECT page_id, {_sql_filing(_MARKED)} AS clean FROM pages")
def g2(spark, d):
    marked = F.concat(F.lit("Form 10-K page 12 ... table of contents Item 7a. "), "html", F.lit(" --- Pursuant to Section 13"))
    return table(spark, d, "pages").select("page_id", tx.clean_filing_text(marked).alias("clean"))


@query("g3_tidy_fields", "SELECT doc_id, trim(regexp_replace(coalesce(nullif(source, 'src1'), ''), '\\s+', ' ', 'g')) AS source, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def g3(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", tx.tidy(F.expr("nullif(source, 'src1')")).alias("source"), tx.tidy(F.col("text")).alias("text"))


@query("g4_counts", """SELECT doc_id, CAST(len(regexp_extract_all(text, '\\S+')) AS INTEGER) AS words, CAST(len(string_split(text, '.')) AS INTEGER) AS sentences,
    CAST(len(string_split(text, chr(10))) AS INTEGER) AS paragraphs, CAST(length(text) AS INTEGER) AS chars FROM documents""")
def g4(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", tx.word_count(t).alias("words"), tx.piece_count(t, "\\.").alias("sentences"), tx.piece_count(t, "\n").alias("paragraphs"), F.length(t).alias("chars"))


@query("g5_combined_text", sql("SELECT doc_id, trim(title || ' ' || description || ' ' || content) AS combined_text FROM news", "news"))
def g5(spark, d):
    return news(spark, d).select("doc_id", tx.combined(F.col("title"), F.col("description"), F.col("content")).alias("combined_text"))


_stop = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)


@query("g6_keywords", f"""WITH l AS (SELECT doc_id, regexp_extract_all(lower(text), '\\S+') AS ws FROM documents),
    w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS place FROM l),
    c AS (SELECT doc_id, word, count(*) AS n, min(place) AS f FROM w WHERE length(word) > 3 AND word NOT IN ({_stop}) GROUP BY 1, 2),
    k AS (SELECT doc_id, word, n, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS INTEGER) AS rank FROM c)
    SELECT * FROM k WHERE rank <= 20""")
def g6(spark, d):
    return tx.keywords(table(spark, d, "documents"), "doc_id", "text")


@query("g8_lexicon_tone", f"""SELECT doc_id, {r('greatest(-c, 0.0)')} AS neg, {r('1 - abs(c)')} AS neu, {r('greatest(c, 0.0)')} AS pos, {r('c')} AS compound
    FROM (SELECT doc_id, {sql_compound('text')} AS c FROM documents)""")
def g8(spark, d):
    c = tone.compound(F.col("text"), CORPUS_POSITIVE, CORPUS_NEGATIVE)
    df = table(spark, d, "documents").select("doc_id", c.alias("compound"))
    return df.select("doc_id", *[rnd(v).alias(k) for k, v in tone.parts(F.col("compound")).items()], rnd("compound").alias("compound"))


@query("g9_score_news", sql(f"SELECT doc_id, {r('tc')} AS title_sentiment_compound, {r('dc')} AS description_sentiment_compound, {r('cc')} AS combined_sentiment_compound, {sql_label('cc')} AS sentiment_label FROM scored", "scored"))
def g9(spark, d):
    cols = [f"{n}_sentiment_compound" for n in ("title", "description", "combined")]
    return scored_news(spark, d).select("doc_id", *[rnd(c).alias(c) for c in cols], "sentiment_label")


@query("g10_score_filings", sql(f"SELECT page_id, {r('m')} AS mda_sentiment, {sql_label('m')} AS mda_sentiment_label, {r('k')} AS risk_factors_sentiment, {sql_label('k')} AS risk_factors_sentiment_label FROM secscored", "secscored"))
def g10(spark, d):
    out = scored_filings(spark, d)
    return out.select("page_id", rnd("mda_sentiment").alias("mda_sentiment"), "mda_sentiment_label", rnd("risk_factors_sentiment").alias("risk_factors_sentiment"), "risk_factors_sentiment_label")


@query("g11_tone_features", sql(f"""SELECT page_id, {r('abs(m)')} AS mda_intensity, {r('abs(k)')} AS risk_factors_intensity, {r('c')} AS combined_sec_sentiment, {sql_label('c')} AS label,
    {r('abs(cc)')} AS news_intensity, {r('1 - abs(tc - dc)')} AS news_consistency FROM secscored JOIN scored ON page_id = doc_id""", "secscored", "scored"))
def g11(spark, d):
    f, n = scored_filings(spark, d), scored_news(spark, d)
    return f.join(n, f.page_id == n.doc_id).select(
        "page_id", rnd("mda_sentiment_intensity").alias("mda_intensity"), rnd("risk_factors_sentiment_intensity").alias("risk_factors_intensity"),
        rnd("combined_sec_sentiment").alias("combined_sec_sentiment"), F.col("combined_sec_sentiment_label").alias("label"),
        rnd("sentiment_intensity").alias("news_intensity"), rnd("sentiment_consistency").alias("news_consistency"))


def sectioned_filings(spark, d):
    """Page text under section headings, as a filing would have it: one page in three as it is, one in six under headings
    that only the header scan knows."""
    p = filings(spark, d)
    inner = F.regexp_replace("html", "(?i)</?(html|body)[^>]*>", "")
    titled = p.withColumn("title_text", F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1))
    body = F.concat(
        F.lit("<html><p>Item 1A. Risk Factors</p>"), inner,
        F.lit("<p>Item 2. Properties</p><p>Item 7. Management's Discussion and Analysis</p>"), F.col("title_text"), F.lit("<p>Item 8. Statements</p></html>"))
    headed = F.concat(F.lit("<html><p>Overview</p><p>Risk Management</p>"), inner, F.lit("<p>Controls and procedures</p><p>Not in it</p></html>"))
    return titled.withColumn("content", F.when(F.col("page_id") % 6 == 2, headed).when(F.col("page_id") % 3 != 0, body).otherwise(F.col("html")))


def _sql_text(c: str) -> str:
    t = c
    for tag in ("script", "style"):
        t = f"regexp_replace({t}, '<{tag}\\b.*?</{tag}\\s*>', ' ', 'gis')"
    t = f"regexp_replace({t}, '<!--.*?-->', ' ', 'gs')"
    t = f"regexp_replace({t}, '</?(p|div|br|li|ul|tr|h[1-6]|article|section|table)\\b[^>]*>', chr(10), 'gi')"
    t = f"regexp_replace({t}, '<[^>]*>', '', 'g')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        t = f"replace({t}, '{entity}', '{char}')"
    return f"CASE WHEN contains(lower({c}), '<html') THEN {t} ELSE {c} END"


def _sql_section(patterns) -> str:
    hits = ", ".join(f"nullif(regexp_extract(t, '{p.replace(chr(39), chr(39) * 2)}', 1, 'is'), '')" for p in patterns)
    e = f"regexp_replace(coalesce({hits}), '\\s+', ' ', 'g')"
    for p, by in (("page\\s+\\d+", ""), ("table\\s+of\\s+contents", ""), ("\\.{3,}", "..."), ("-{3,}", "---")):
        e = f"regexp_replace({e}, '{p}', '{by}', 'gi')"
    return f"coalesce(trim({e}), '')"


_INNER = "regexp_replace(html, '</?(html|body)[^>]*>', '', 'gi')"
_TITLES = "CASE " + " ".join(f"WHEN contains(lower(line), '{t.lower().replace(chr(39), chr(39) * 2)}') THEN '{t.lower().replace(chr(39), '').replace(' ', '_')}'" for t in tx.SECTION_TITLES) + " END"
_STOPS = " OR ".join(f"contains(lower(line), '{t}')" for t in tx.STOP_TITLES)
HEADERS = dict(
    con=f"""SELECT *, CASE WHEN page_id % 6 = 2 THEN '<html><p>Overview</p><p>Risk Management</p>' || {_INNER} || '<p>Controls and procedures</p><p>Not in it</p></html>'
      WHEN page_id % 3 <> 0 THEN '<html><p>Item 1A. Risk Factors</p>' || {_INNER} || '<p>Item 2. Properties</p><p>Item 7. Management''s Discussion and Analysis</p>'
        || regexp_extract(html, '<title>(.*?)</title>', 1, 'is') || '<p>Item 8. Statements</p></html>' ELSE html END AS content FROM filings""",
    txt=f"SELECT *, {_sql_text('content')} AS t FROM con",
    ln="SELECT page_id, unnest(string_split(t, chr(10))) AS raw, generate_subscripts(string_split(t, chr(10)), 1) AS no FROM txt",
    hd=f"SELECT *, CASE WHEN length(line) < {tx.HEADER_LENGTH} THEN {_TITLES} END AS head, {_STOPS} AS stop FROM (SELECT page_id, no, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS line FROM ln) WHERE line <> ''",
    bl="SELECT *, max(CASE WHEN head IS NOT NULL THEN no END) OVER (PARTITION BY page_id ORDER BY no) AS block FROM hd",
    ins="SELECT *, coalesce(bool_or(stop) OVER (PARTITION BY page_id, block ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS past FROM bl WHERE block IS NOT NULL",
    bs="SELECT page_id, block, max(head) AS section, string_agg(line, chr(10) ORDER BY no) AS text FROM ins WHERE NOT past GROUP BY 1, 2",
    hs="SELECT page_id, section, arg_max(text, block) AS text FROM bs GROUP BY 1, 2",
)


@query("g12_extract_sections", sql("""SELECT page_id, Symbol, filing_date, form_type, mda_text, risk_factors_text, CAST(length(mda_text) AS INTEGER) AS mda_length,
      CAST(length(risk_factors_text) AS INTEGER) AS risk_factors_length, found OR page_id IN (SELECT page_id FROM hs) AS extraction_success
    FROM (SELECT page_id, Symbol, filing_date, form_type, found, m AS mda_text, CASE WHEN found THEN k ELSE coalesce(text, '') END AS risk_factors_text
      FROM (SELECT *, m <> '' OR k <> '' AS found FROM sx) LEFT JOIN (SELECT page_id, text FROM hs WHERE section = 'risk_factors') USING (page_id))""", "filings", **HEADERS,
    sx=f"SELECT *, {_sql_section(tx.SECTION_PATTERNS['mda'])} AS m, {_sql_section(tx.SECTION_PATTERNS['risk_factors'])} AS k FROM txt"))
def g12(spark, d):
    return tx.extract_sections(sectioned_filings(spark, d), "content").select(
        "page_id", "Symbol", "filing_date", "form_type", "mda_text", "risk_factors_text", "mda_length", "risk_factors_length", "extraction_success")


@query("g13_header_sections", sql("SELECT * FROM hs", "filings", **HEADERS))
def g13(spark, d):
    return tx.header_sections(sectioned_filings(spark, d), "page_id", "content")


@query("g14_tidy_section", """SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace('Page 3 .... ' || html || ' table  of contents -----',
    '\\s+', ' ', 'g'), 'page\\s+\\d+', '', 'gi'), 'table\\s+of\\s+contents', '', 'gi'), '\\.{3,}', '...', 'g'), '-{3,}', '---', 'g')) AS tidy FROM pages""")
def g14(spark, d):
    t = F.concat(F.lit("Page 3 .... "), "html", F.lit(" table  of contents -----"))
    return table(spark, d, "pages").select("page_id", tx.tidy_section(t).alias("tidy"))


@query("b13_drop_short_texts", sql("""SELECT 'news' AS kind, doc_id AS id FROM news WHERE len(regexp_extract_all(trim(title || ' ' || description || ' ' || content), '\\S+')) >= 5
    UNION ALL SELECT 'filing', page_id FROM sections WHERE len(regexp_extract_all(mda_text, '\\S+')) >= 100""", "news", "sections"))
def b13(spark, d):
    n = news(spark, d).where(tx.word_count(tx.combined(F.col("title"), F.col("description"), F.col("content"))) >= tx.MIN_NEWS_WORDS)
    f = filing_sections(spark, d).where(tx.word_count(F.col("mda_text")) >= tx.MIN_FILING_WORDS)
    return n.select(F.lit("news").alias("kind"), F.col("doc_id").alias("id")).unionByName(f.select(F.lit("filing").alias("kind"), F.col("page_id").alias("id")))


@query("d1_daily_news", sql(f"""SELECT Symbol, Date, {r('nm')} AS news_sentiment_mean, {r('ns')} AS news_sentiment_std, nc AS news_count, {r('ni')} AS news_sentiment_intensity,
    {r('ntl')} AS news_title_length_avg, {r('ndl')} AS news_desc_length_avg FROM dailynews""", "dailynews"))
def d1(spark, d):
    out = tone.daily_news(scored_news(spark, d))
    floats = ["news_sentiment_mean", "news_sentiment_std", "news_sentiment_intensity", "news_title_length_avg", "news_desc_length_avg"]
    return out.select("Symbol", "Date", "news_count", *[rnd(c).alias(c) for c in floats])


@query("d2_tone_by_source_day", sql(f"""SELECT Symbol, Date, {r('nm')} AS a, {r('nt')} AS b, {r('nd')} AS c, 'news' AS data_source FROM dailynews
    UNION ALL SELECT Symbol, Date, {r('sm')}, {r('sk')}, {r('sc')}, 'sec' FROM dailysec""", "dailynews", "dailysec"))
def d2(spark, d):
    n = tone.daily_news(scored_news(spark, d)).select("Symbol", "Date", rnd("news_sentiment_mean").alias("a"), rnd("news_title_sentiment").alias("b"), rnd("news_description_sentiment").alias("c"), F.lit("news").alias("data_source"))
    f = tone.daily_filings(scored_filings(spark, d)).select("Symbol", "Date", rnd("sec_mda_sentiment").alias("a"), rnd("sec_risk_sentiment").alias("b"), rnd("sec_combined_sentiment").alias("c"), F.lit("sec").alias("data_source"))
    return n.unionByName(f)


@query("d3_daily_tone_attached", sql(f"SELECT doc_id, {r('avg(cc) OVER (PARTITION BY Symbol, published_date)')} AS daily_avg_sentiment FROM scored", "scored"))
def d3(spark, d):
    return tone.daily_tone_attached(scored_news(spark, d)).select("doc_id", rnd("daily_avg_sentiment").alias("daily_avg_sentiment"))


@query("e16_article_tone_volatility", sql(f"SELECT doc_id, {r('stddev_samp(cc) OVER (PARTITION BY Symbol ORDER BY published_date, doc_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)')} AS sentiment_volatility FROM scored", "scored"))
def e16(spark, d):
    out = tone.article_tone_volatility(scored_news(spark, d).select("doc_id", "Symbol", "published_date", "combined_sentiment_compound"), ["published_date", "doc_id"])
    return out.select("doc_id", rnd("sentiment_volatility").alias("sentiment_volatility"))


@query("e17_tone_indicators", sql(f"""SELECT Symbol, Date, {r('avg(nm) OVER ' + last(7))} AS news_sentiment_ma7, {r('avg(nm) OVER ' + last(30))} AS news_sentiment_ma30,
    {r('avg(nm) OVER ' + last(7) + ' - avg(nm) OVER ' + last(30))} AS news_sentiment_trend, {r('avg(ns) OVER ' + last(7))} AS sentiment_volatility_ma7,
    {r('avg(nc) OVER ' + last(7))} AS news_volume_ma7, CASE WHEN nc > 2 * avg(nc) OVER (PARTITION BY Symbol) THEN 1 ELSE 0 END AS high_news_volume FROM dailynews""", "dailynews"))
def e17(spark, d):
    out = ind.tone_indicators(tone.daily_news(scored_news(spark, d)))
    floats = ["news_sentiment_ma7", "news_sentiment_ma30", "news_sentiment_trend", "sentiment_volatility_ma7", "news_volume_ma7"]
    return out.select("Symbol", "Date", *[rnd(c).alias(c) for c in floats], "high_news_volume")


@query("e18_change_since_filing", sql(f"SELECT page_id, {r('k - lag(k) OVER (PARTITION BY Symbol ORDER BY filing_date, page_id)')} AS risk_sentiment_change FROM secscored", "secscored"))
def e18(spark, d):
    f = scored_filings(spark, d).select("page_id", "Symbol", "filing_date", "risk_factors_sentiment")
    return tone.change_since_previous_filing(f, ["filing_date", "page_id"]).select("page_id", rnd("risk_sentiment_change").alias("risk_sentiment_change"))


@query("e19_tone_momentum", sql("SELECT Symbol, Date, " + ", ".join(
    f"{r(f'nm / nullif(lag(nm, {k}) OVER (PARTITION BY Symbol ORDER BY Date), 0) - 1')} AS sentiment_momentum_{k}d" for k in (1, 3, 7)) + " FROM dailynews", "dailynews"))
def e19(spark, d):
    out = ind.tone_momentum(tone.daily_news(scored_news(spark, d)), "news_sentiment_mean", s=SYMBOL_DAY)
    return out.select("Symbol", "Date", *[rnd(f"sentiment_momentum_{k}d").alias(f"sentiment_momentum_{k}d") for k in (1, 3, 7)])
