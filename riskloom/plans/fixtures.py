"""The given tables shaped as panels, news, filings, vectors and predictions.

Each adapter has a twin in ``CTES`` for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.series import SYMBOL_DAY
from riskloom.operators import indicators as ind
from riskloom.operators import labels as lab
from riskloom.operators.labels import clip
from riskloom.session import checkpoint

EPOCH_DAY = "1995-01-02"
CALENDAR_DAYS = 2499


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Rounding for results that are compared: the odd offset keeps exact halves, which averages
    of short decimals often are, out of the decision."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 10.0**digits + 0.500137) / 10.0**digits


def tick(c: Column) -> Column:
    """Price in millionths. The odd offset keeps exact halves out of the rounding decision, which
    would otherwise depend on the order of a floating-point sum."""
    return F.floor(c * 1e6 + 0.637) / 1e6


def sql_tick(e: str) -> str:
    return f"(floor(({e}) * 1e6 + 0.637) / 1e6)"


def brand(n: Column) -> Column:
    return F.concat(F.lit("Brand#"), (1 + n % 25).cast("string"))


def spread_day(n: Column, factor: int) -> Column:
    return F.date_add(F.to_date(F.lit(EPOCH_DAY)), ((n * factor) % CALENDAR_DAYS).cast("int"))


def panel(spark: SparkSession, d: str) -> DataFrame:
    """Brand-day price bars. Partial aggregation runs before the only shuffle by (brand, day)."""
    price = F.try_divide("l_extendedprice", "l_quantity")
    items = table(spark, d, "lineitem").select(
        "l_partkey", F.col("l_shipdate").cast("date").alias("Date"), price.alias("p"), F.col("l_quantity").alias("q")
    )
    parts = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("Symbol"))
    return (
        items.join(parts, items.l_partkey == parts.p_partkey)
        .groupBy("Symbol", "Date")
        .agg(
            tick((F.max("p") + F.min("p")) / 2).alias("Open"),
            tick(F.max("p")).alias("High"),
            tick(F.min("p")).alias("Low"),
            tick(F.avg("p")).alias("Close"),
            F.sum("q").alias("Volume"),
        )
    )


def panel_returns(spark: SparkSession, d: str) -> DataFrame:
    return ind.returns(panel(spark, d))


def event_bars(spark: SparkSession, d: str, unit: str = "day") -> DataFrame:
    e = table(spark, d, "events").withColumn("bar", F.date_trunc(unit, "ts"))
    e = e.withColumn("o", F.struct("ts", "event_id"))
    out = e.groupBy(F.col("event_type").alias("Symbol"), "bar").agg(
        F.min_by("value", "o").alias("Open"), F.max("value").alias("High"), F.min("value").alias("Low"),
        F.max_by("value", "o").alias("Close"), F.count(F.lit(1)).alias("Volume"),
    )
    return out.withColumn("Date", F.col("bar").cast("date")) if unit == "day" else out


def nation_panel(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("Date"), "o_totalprice")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("Symbol"))
    return o.join(c, o.o_custkey == c.c_custkey).groupBy("Symbol", "Date").agg(tick(F.avg("o_totalprice")).alias("Close"))


def gappy_panel(spark: SparkSession, d: str) -> DataFrame:
    number = F.substring_index("Symbol", "#", -1).cast("int")
    gap = (F.dayofyear("Date") + number) % 7 == 0
    return panel(spark, d).withColumns({c: F.when(~gap, F.col(c)) for c in ("Close", "Volume")})


def fundamentals(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "part")
        .groupBy(F.col("p_brand").alias("Symbol"))
        .agg(
            tick(F.avg("p_size")).alias("PE_Ratio"),
            tick(F.stddev_samp("p_retailprice") / F.avg("p_retailprice")).alias("Beta"),
            tick(F.sum("p_retailprice")).alias("Market_Cap"),
        )
    )


def news(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    return table(spark, d, "documents").select(
        "doc_id",
        brand(n).alias("Symbol"),
        spread_day(F.floor(n / 75), 37).alias("published_date"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.split_part("text", F.lit("\n"), F.lit(2)).alias("description"),
        F.col("text").alias("content"),
        F.concat(F.lit("doc/"), n.cast("string")).alias("url"),
        F.col("source").alias("api_source"),
        "lang",
    )


def filings(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id")
    return table(spark, d, "pages").select(
        "page_id",
        brand(n).alias("Symbol"),
        spread_day(F.floor(n / 50), 91).alias("filing_date"),
        F.when(n % 4 == 0, "10-K").otherwise("10-Q").alias("form_type"),
        "url",
        "html",
    )


def vectors(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("vec_id")
    return table(spark, d, "embeddings").select("vec_id", brand(n).alias("Symbol"), spread_day(F.floor(n / 50), 5).alias("Date"), "embedding", "label")


ELEMENTS = [f"e{i}" for i in range(64)]
VECTOR_MEANS = "SELECT Symbol, Date, " + ", ".join(f"avg(embedding[{i + 1}]::DOUBLE) AS {e}" for i, e in enumerate(ELEMENTS)) + " FROM vectors GROUP BY 1, 2"


def vector_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean vector per symbol and day, a column per element."""
    return vectors(spark, d).groupBy("Symbol", "Date").agg(*[F.avg(F.col("embedding")[i].cast("double")).alias(e) for i, e in enumerate(ELEMENTS)])


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return lab.label_mean_step(panel_returns(spark, d))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Three scores per brand-day: from 20-row and 5-row volatility, and the share of falls."""
    s = SYMBOL_DAY
    falls = F.avg(F.when(F.col("Returns") < 0, 1.0).otherwise(0.0)).over(s.last(10))
    df = labelled(spark, d).withColumns({"_v20": s.std("Returns", 20), "_v5": s.std("Returns", 5), "_falls": falls})
    df = checkpoint(df.select("Symbol", "Date", "Close", "Returns", "Risk_Label", "Risk_Score", "_v20", "_v5", "_falls"))
    mean_dev = df.agg(
        F.avg("_v20").alias("m20"), F.stddev_samp("_v20").alias("d20"), F.avg("_v5").alias("m5"), F.stddev_samp("_v5").alias("d5")
    )
    df = df.withColumn("_m", mean_dev.select(F.struct(*mean_dev.columns)).scalar())

    def prob(v: str, m: str, dev: str) -> Column:
        z = (F.col(v) - F.col(f"_m.{m}")) / F.col(f"_m.{dev}")
        return rnd(F.coalesce(clip(0.5 + 0.25 * z, 0.0, 1.0), F.lit(0.5)))

    return df.withColumns({"Risk_Probability": prob("_v20", "m20", "d20"), "prob_b": prob("_v5", "m5", "d5"), "prob_c": rnd("_falls")}).select(
        "Symbol", "Date", "Close", "Returns", "Risk_Label", rnd("Risk_Score").alias("Risk_Score"), "Risk_Probability", "prob_b", "prob_c"
    )


def text_labels(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "labels")
    t = table(spark, d, "documents").select("doc_id", "n_chars", "source", "lang")
    return l.join(t, "doc_id").select(
        "doc_id", "source", "lang", F.col("quality").cast("int").alias("label"), rnd(F.col("n_chars") / (F.col("n_chars") + 2000.0)).alias("score")
    )


# Event windows over the days the given tables cover, one outside them.
EVENTS = [
    ("Spring Slide", "1996-03-01", "1996-06-30", "correction"),
    ("Summer Shock", "1997-07-01", "1997-12-31", "crash"),
    ("Long Squeeze", "1998-08-01", "1999-10-31", "bear_market"),
    ("Late Tightening", "2000-02-01", "2001-03-31", "policy"),
    ("Future Crisis", "2020-02-01", "2020-12-31", "crash"),
]
EVENT_SCHEMA = "name string, start_date string, end_date string, type string"


def events_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EVENTS, EVENT_SCHEMA).withColumns({c: F.to_date(c) for c in ("start_date", "end_date")})


W = "PARTITION BY Symbol ORDER BY Date"


def win(start: str, end: str = "CURRENT ROW") -> str:
    return f"({W} ROWS BETWEEN {start} AND {end})"


def last(k: int) -> str:
    return win(f"{k - 1} PRECEDING")


def full(agg: str, col: str, k: int, frame: str | None = None, at_least: int | None = None) -> str:
    """SQL twin of ``Series.full``."""
    f = frame or last(k)
    return f"(CASE WHEN count({col}) OVER {f} >= {at_least or k} THEN {agg} OVER {f} END)"


def r(expr: str, digits: int = 6) -> str:
    return f"(floor(({expr}) * 1e{digits} + 0.500137) / 1e{digits})"


def plain_round(expr: str, digits: int) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


def change(col: str, k: int = 1) -> str:
    return f"({col} / nullif(lag({col}, {k}) OVER ({W}), 0) - 1)"


def sql_clip(e: str, lo: float, hi: float) -> str:
    return f"(CASE WHEN {e} < {lo} THEN {lo} WHEN {e} > {hi} THEN {hi} ELSE {e} END)"


_AHEAD5 = win("1 FOLLOWING", "5 FOLLOWING")

CTES: dict[str, str] = {
    "panel": f"""SELECT Symbol, Date, {sql_tick('(hi + lo) / 2')} AS Open, {sql_tick('hi')} AS High, {sql_tick('lo')} AS Low, {sql_tick('mean')} AS Close, Volume
      FROM (SELECT p_brand AS Symbol, CAST(l_shipdate AS DATE) AS Date, max(l_extendedprice / l_quantity) AS hi, min(l_extendedprice / l_quantity) AS lo,
      avg(l_extendedprice / l_quantity) AS mean, sum(l_quantity) AS Volume FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)""",
    "ret": f"SELECT *, {change('Close')} AS Returns FROM panel",
    "nations": f"""SELECT CAST(c_nationkey AS VARCHAR) AS Symbol, CAST(o_orderdate AS DATE) AS Date, {sql_tick('avg(o_totalprice)')} AS Close
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
    "gappy": """SELECT Symbol, Date, Open, High, Low,
      CASE WHEN (dayofyear(Date) + CAST(split_part(Symbol, '#', 2) AS INTEGER)) % 7 <> 0 THEN Close END AS Close,
      CASE WHEN (dayofyear(Date) + CAST(split_part(Symbol, '#', 2) AS INTEGER)) % 7 <> 0 THEN Volume END AS Volume FROM panel""",
    "fund": f"""SELECT p_brand AS Symbol, {sql_tick('avg(p_size)')} AS PE_Ratio,
      {sql_tick('stddev_samp(p_retailprice) / avg(p_retailprice)')} AS Beta, {sql_tick('sum(p_retailprice)')} AS Market_Cap FROM part GROUP BY 1""",
    "news": f"""SELECT doc_id, 'Brand#' || (1 + doc_id % 25) AS Symbol,
      CAST(DATE '{EPOCH_DAY}' + CAST((doc_id // 75 * 37) % {CALENDAR_DAYS} AS INTEGER) AS DATE) AS published_date,
      split_part(text, chr(10), 1) AS title, split_part(text, chr(10), 2) AS description, text AS content,
      'doc/' || doc_id AS url, source AS api_source, lang FROM documents""",
    "filings": f"""SELECT page_id, 'Brand#' || (1 + page_id % 25) AS Symbol,
      CAST(DATE '{EPOCH_DAY}' + CAST((page_id // 50 * 91) % {CALENDAR_DAYS} AS INTEGER) AS DATE) AS filing_date,
      CASE WHEN page_id % 4 = 0 THEN '10-K' ELSE '10-Q' END AS form_type, url, html FROM pages""",
    "vectors": f"""SELECT vec_id, 'Brand#' || (1 + vec_id % 25) AS Symbol,
      CAST(DATE '{EPOCH_DAY}' + CAST((vec_id // 50 * 5) % {CALENDAR_DAYS} AS INTEGER) AS DATE) AS Date, embedding, label FROM embeddings""",
    "fut": f"""SELECT *, {full('avg(Returns)', 'Returns', 5, _AHEAD5)} AS Future_Return,
      {full('stddev_samp(Returns)', 'Returns', 5, _AHEAD5)} AS Future_Volatility FROM ret""",
    "labelled": f"""SELECT *, CASE WHEN Future_Volatility > 0.02 OR Future_Return < -0.05 THEN 1 ELSE 0 END AS Risk_Label,
      coalesce({sql_clip(f"(({sql_clip('Future_Volatility / 0.02', 0.0, 2.0)} / 2 + {sql_clip('Future_Return / -0.05', 0.0, 2.0)} / 2) / 2)", 0.0, 1.0)}, 0.0) AS Risk_Score FROM fut""",
    "vols": f"""SELECT *, {full('stddev_samp(Returns)', 'Returns', 20)} AS v20, {full('stddev_samp(Returns)', 'Returns', 5)} AS v5,
      avg(CASE WHEN Returns < 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER {last(10)} AS falls FROM labelled""",
    "vstat": "SELECT avg(v20) m20, stddev_samp(v20) d20, avg(v5) m5, stddev_samp(v5) d5 FROM vols",
    "pred": f"""SELECT Symbol, Date, Close, Returns, Risk_Label, {r('Risk_Score')} AS Risk_Score,
      {r(f"coalesce({sql_clip('(0.5 + 0.25 * (v20 - m20) / d20)', 0.0, 1.0)}, 0.5)")} AS Risk_Probability,
      {r(f"coalesce({sql_clip('(0.5 + 0.25 * (v5 - m5) / d5)', 0.0, 1.0)}, 0.5)")} AS prob_b,
      {r('falls')} AS prob_c FROM vols, vstat""",
    "textlabels": f"""SELECT doc_id, source, lang, CAST(quality AS INTEGER) AS label, {r('n_chars / (n_chars + 2000.0::DOUBLE)')} AS score
      FROM labels JOIN documents USING (doc_id)""",
    "windows": "SELECT name, CAST(s AS DATE) AS start_date, CAST(e AS DATE) AS end_date, type FROM (VALUES "
    + ", ".join(f"('{n}', '{a}', '{b}', '{t}')" for n, a, b, t in EVENTS)
    + ") v(name, s, e, type)",
}
NEEDS: dict[str, tuple[str, ...]] = {
    "ret": ("panel",), "gappy": ("panel",), "fut": ("ret",), "labelled": ("fut",), "vols": ("labelled",), "vstat": ("vols",), "pred": ("vols", "vstat"),
}


def sql(body: str, *needs: str, **ctes: str) -> str:
    """A statement with the fixture CTEs it needs, then ``ctes`` in order, then the body."""
    ordered: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, ()):
            add(m)
        if n not in ordered:
            ordered.append(n)

    for n in needs:
        add(n)
    parts = [f"{n} AS ({CTES[n]})" for n in ordered] + [f"{n} AS ({q})" for n, q in ctes.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + body


# Frequent word starts of the given texts, which the default stems do not occur in.
CORPUS_POSITIVE = "the tio que men ein ene ono sch ane thin mente orant".split()
CORPUS_NEGATIVE = "tha tht ere ing one ert ths ble ero than ering onble".split()


def scored_news(spark: SparkSession, d: str) -> DataFrame:
    from riskloom.functions.tone import score_news

    return score_news(news(spark, d), CORPUS_POSITIVE, CORPUS_NEGATIVE)


def filing_sections(spark: SparkSession, d: str) -> DataFrame:
    """Filings whose two sections are the first and the rest of the page's readable text."""
    from riskloom.functions.text import clean_text

    text = clean_text(F.col("html"))
    half = F.floor(F.length("t") / 2)
    return (
        filings(spark, d)
        .withColumn("t", text)
        .withColumns({"mda_text": F.substring("t", F.lit(1), half.cast("int")), "risk_factors_text": F.substring("t", (half + 1).cast("int"), F.length("t"))})
        .drop("t", "html")
    )


def scored_filings(spark: SparkSession, d: str) -> DataFrame:
    from riskloom.functions.tone import score_filings

    return score_filings(filing_sections(spark, d), positive=CORPUS_POSITIVE, negative=CORPUS_NEGATIVE)


def sql_compound(t: str) -> str:
    def hits(stems: list[str]) -> str:
        return f"len(regexp_extract_all(lower({t}), '(^|[^a-z''])({'|'.join(stems)})'))"

    p, n = hits(CORPUS_POSITIVE), hits(CORPUS_NEGATIVE)
    return f"(({p} - {n})::DOUBLE / greatest({p} + {n}, 1))"


def sql_label(c: str) -> str:
    return f"CASE WHEN {c} >= 0.05 THEN 'positive' WHEN {c} <= -0.05 THEN 'negative' ELSE 'neutral' END"


def sql_clean(t: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(regexp_replace(coalesce({t}, ''), '<[^>]+>', ' ', 'g'), "
        f"'[^\\p{{L}}\\p{{N}}_\\s.,!?;:()\\-''\"$%]', ' ', 'g'), '\\s+', ' ', 'g'))"
    )


CTES["scored"] = f"""SELECT doc_id, Symbol, published_date, title, description, api_source, lang, {sql_compound('title')} AS tc, {sql_compound('description')} AS dc,
  {sql_compound("trim(title || ' ' || description || ' ' || content)")} AS cc,
  len(regexp_extract_all(title, '\\S+')) AS tw, len(regexp_extract_all(description, '\\S+')) AS dw FROM news"""
CTES["dailynews"] = """SELECT Symbol, published_date AS Date, avg(cc) AS nm, coalesce(stddev_samp(cc), 0) AS ns, count(cc) AS nc, avg(abs(cc)) AS ni,
  avg(tw) AS ntl, avg(dw) AS ndl, avg(tc) AS nt, avg(dc) AS nd FROM scored GROUP BY 1, 2"""
CTES["sections"] = f"""SELECT page_id, Symbol, filing_date, form_type, url, left(t, CAST(length(t) // 2 AS BIGINT)) AS mda_text,
  substr(t, CAST(length(t) // 2 + 1 AS BIGINT)) AS risk_factors_text FROM (SELECT *, {sql_clean('html')} AS t FROM filings)"""
CTES["secscored"] = f"""SELECT *, (m + k) / 2 AS c FROM (SELECT *, {sql_compound('mda_text')} AS m, {sql_compound('risk_factors_text')} AS k FROM sections)"""
CTES["dailysec"] = "SELECT Symbol, filing_date AS Date, avg(m) AS sm, avg(k) AS sk, avg(c) AS sc FROM secscored GROUP BY 1, 2"
NEEDS.update({"scored": ("news",), "dailynews": ("scored",), "sections": ("filings",), "secscored": ("sections",), "dailysec": ("secscored",)})
