import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskloom.functions import text as tx
from riskloom.functions import tone


def test_tone_signs(spark):
    rows = [("Great results, strong growth!", 1.0), ("A terrible crash and a big loss", -1.0), ("Nothing to see", 0.0), ("", 0.0), (None, 0.0), ("Good day but bad risk ahead, so goodness", 0.0)]
    got = [r["c"] for r in spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string").select("i", tone.compound(F.col("t")).alias("c")).orderBy("i").collect()]
    assert got == [s for _, s in rows]


def test_stem_hits_equal_token_loop(spark):
    texts = ["up upon UPWARD don't gain's regain gain-gain good,goods xgood 'good '' up'up", "ÉGOOD good", "word\ngood\tup."]
    stems = ["up", "gain", "good"]
    got = [r["n"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tone.stem_hits(F.col("t"), stems).alias("n")).orderBy("i").collect()]
    want = [sum(any(tok.startswith(s) for s in stems) for tok in re.findall(r"[a-z']+", t.lower())) for t in texts]
    assert got == want


def test_keywords_equal_counter(spark):
    text = "Alpha beta alpha gamma about which delta beta alpha four fours the these delta"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    got = [(r["word"], r["n"]) for r in tx.keywords(df, "id", "text", 3).orderBy("rank").collect()]
    words = [w for w in text.lower().split() if len(w) > 3 and w not in tx.STOP_WORDS]
    assert got == Counter(words).most_common(3)


def test_clean_text_keeps_letters_of_all_languages(spark):
    t = "<b>Çà</b>  l'été — 50% #up\n(ok) 東京"
    got = spark.createDataFrame([(t,)], "t string").select(tx.clean_text(F.col("t"))).first()[0]
    want = re.sub(r"\s+", " ", re.sub(r"[^\w\s.,!?;:()\-'\"$%]", " ", re.sub(r"<[^>]+>", " ", t))).strip()
    assert got == want


BOTH = "Item 1A. Risk Factors\nWe may fail.\nItem 2. Properties\nItem 7. Management's Discussion and Analysis\nSales rose... Page 3\nItem 8. Statements"


@pytest.mark.parametrize("content,mda,risk", [
    (BOTH, "Item 7. Management's Discussion and Analysis Sales rose...", "Item 1A. Risk Factors We may fail."),
    ("<html><p>" + BOTH.replace("\n", "</p><p>") + "</p></html>", "Item 7. Management's Discussion and Analysis Sales rose...", "Item 1A. Risk Factors We may fail."),
    ("MD&A results\nRisk Factors none\n Item 9", "MD&A results", "Risk Factors none"),
    ("nothing here", "", ""),
])
def test_sections(spark, content, mda, risk):
    row = tx.extract_sections(spark.createDataFrame([(content,)], "c string"), "c").first()
    assert row["mda_text"] == mda and row["risk_factors_text"] == risk
    assert row["extraction_success"] == bool(mda or risk) and row["mda_length"] == len(mda)


def test_header_fallback(spark):
    text = "intro\nBusiness Risks\nline one\n\nline two\nControls and procedures here\nafter\nRisk Management\nlast line"
    rows = {r["section"]: r["text"] for r in tx.header_sections(spark.createDataFrame([(1, text)], "id int, c string"), "id", "c").collect()}
    assert rows == {"business_risks": "Business Risks\nline one\nline two\nControls and procedures here", "risk_management": "Risk Management\nlast line"}


def scanned(text):
    """The header scan, line by line."""
    found, name, held = {}, None, []
    for line in (x.strip() for x in text.split("\n")):
        title = next((t for t in tx.SECTION_TITLES if t.lower() in line.lower()), None)
        if title and len(line) < tx.HEADER_LENGTH:
            if name:
                found[name] = "\n".join(held)
            name, held = title.lower().replace("'", "").replace(" ", "_"), []
        if name and line:
            held.append(line)
            if any(t in line.lower() for t in tx.STOP_TITLES):
                found[name] = "\n".join(held)
                name = None
    if name:
        found[name] = "\n".join(held)
    return found


def test_header_scan_equals_loop(spark):
    rng = random.Random(11)
    parts = ["plain words", "\tMD&A overview", "Risk Factors", "risk management and controls and procedures", "Business Risks  ", "see item 3 below", "", "  ",
             "x" * 190 + " Risk Factors", "Management's Discussion and Analysis", "MD&A and Risk Factors", "\r", "last\r"]
    texts = ["\n".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(400)] + ["", "Risk Factors", "Risk Factors\nitem 2\nMD&A", "\n".join(parts * 3000)]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "id int, c string")
    got = {i: {} for i in range(-1, len(texts))}
    for r in tx.header_sections(df, "id", "c").collect():
        got[r["id"]][r["section"]] = r["text"]
    assert got == {-1: {}, **{i: scanned(t) for i, t in enumerate(texts)}}


def test_fallback_only_without_pattern(spark):
    # "risk factors" opens a pattern section; "Risk Management" is known to the header scan alone
    rows = [(1, "Risk Management\nwe hedge"), (2, "Risk Factors\nnone\nRisk Management\nwe hedge"), (3, "nothing"), (4, None)]
    df = spark.createDataFrame(rows, "id int, c string")
    got = {r["id"]: (r["mda_text"], r["risk_factors_text"], r["extraction_success"]) for r in tx.extract_sections(df, "c").collect()}
    assert got == {1: ("", "", True), 2: ("", "Risk Factors none Risk Management we hedge", True), 3: ("", "", False), 4: ("", "", False)}
    own = {"risk_management": [r"(hedging policy.*)"]}
    got = {r["id"]: (r["risk_management_text"], r["extraction_success"]) for r in tx.extract_sections(df, "c", own).collect()}
    assert got == {1: ("Risk Management\nwe hedge", True), 2: ("Risk Management\nwe hedge", True), 3: ("", False), 4: ("", False)}


def test_counts_of_empty_text(spark):
    row = spark.createDataFrame([("", "a. b.\nc")], "e string, t string").select(tx.word_count(F.col("e")), tx.piece_count(F.col("t"), "\\."), tx.piece_count(F.col("t"), "\n")).first()
    assert list(row) == [0, 3, 2]


def test_filing_change_and_article_volatility(spark):
    rows = [("A", 1, 0.5), ("A", 2, 0.2), ("B", 1, 0.9)]
    df = spark.createDataFrame(rows, "Symbol string, filing_date int, risk_factors_sentiment double")
    got = {(r["Symbol"], r["filing_date"]): r["risk_sentiment_change"] for r in tone.change_since_previous_filing(df, ["filing_date"]).collect()}
    assert got["A", 1] is None and got["B", 1] is None and got["A", 2] == pytest.approx(-0.3)
