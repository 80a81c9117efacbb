"""Secret candidates against a plain search, planted keys, texts of many candidates; which of repeated rows the pipeline keeps."""

import hashlib
import re
import time

import regex
from pyspark.sql import functions as F

from tesserae.llm import secret_scan

DATA = "/root/testdata/sf0.01"
RUN = "[A-Za-z0-9_+/-]"


def candidates(text):
    """Runs of key characters of 12 or more that hold a digit, with their padding."""
    out = []
    for m in regex.finditer(rf"{RUN}+", text or ""):
        if len(m[0]) >= 12 and any(c.isascii() and c.isdigit() for c in m[0]):
            pad = re.match("={0,2}", text[m.end() :])[0]
            out.append((m.start(), m[0] + pad))
    return out


def test_candidates_are_what_a_plain_search_finds(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = sorted((r["doc_id"], r["start"], r["value_sha256"]) for r in secret_scan.scan(docs).collect())
    want = sorted((r["doc_id"], at, hashlib.sha256(v.encode()).hexdigest()) for r in docs.collect() for at, v in candidates(r["text"]))
    assert found == want and len(want) > 20


def test_planted_keys_are_told_from_card_numbers(spark):
    """Of what the texts hold by its form: access keys and assigned hexadecimal values are secrets, bare digits aren't."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    said = {(r["doc_id"], r["start"]): r["is_secret"] for r in secret_scan.scan(docs).collect()}
    keys, digits = [], []
    for r in docs.collect():
        for at, value in candidates(r["text"]):
            before = r["text"][:at]
            if re.fullmatch("AKIA[A-Z0-9]{16}", value) or (re.search(r"(?:password|token|secret|api_key)\s*[=:]\s*[\"']?$", before) and re.fullmatch("[0-9a-f]{16,}", value)):
                keys.append(said[r["doc_id"], at])
            if re.fullmatch("[0-9]{12,19}", value):
                digits.append(said[r["doc_id"], at])
    assert len(keys) > 10 and sum(keys) / len(keys) >= 0.95
    assert len(digits) > 10 and sum(digits) / len(digits) <= 0.05


def test_work_grows_with_the_candidates(spark, monkeypatch):
    """A text of 10,000 keys; starts are summed by blocks, whatever their size."""
    score = secret_scan.train(secret_scan.labelled_findings(spark))
    monkeypatch.setattr(secret_scan, "_score", lambda docs, findings: score)
    text = " é ".join("token = " + hashlib.sha256(str(i).encode()).hexdigest()[:20] for i in range(10_000))
    one = spark.createDataFrame([(1, text, len(text))], "doc_id long, text string, n_chars long")
    began = time.time()
    rows = secret_scan.scan(one).collect()
    assert time.time() - began < 60 and len(rows) == 10_000
    assert sorted((r["start"], r["value_sha256"]) for r in rows) == sorted((at, hashlib.sha256(v.encode()).hexdigest()) for at, v in candidates(text))
    assert secret_scan.redact(one).first()["text"].count(secret_scan.MASK) == sum(r["is_secret"] for r in rows)
    monkeypatch.setattr(secret_scan, "BLOCK", 3)
    few = spark.createDataFrame([(1, text[:2000])], "doc_id long, text string")
    assert sorted(r["start"] for r in secret_scan.scan(few).collect()) == [at for at, _ in candidates(text[:2000])]


def test_which_of_repeated_rows_stays(spark):
    import corpus_pipeline as pipeline

    prose = "Plain prose of some length about rivers and hills, told by one who walked there in June and again in May."
    rows = [(1, None, "b"), (1, None, "a"), (2, "", "a"), (2, "", "a"), (3, " \n", "a"), (3, " \n", "a"), (4, prose, "z"), (4, prose, "m"), (4, prose, None), (5, prose + " Twice.", "q"), (6, "one", "s"), (6, "one", "s"), (6, "two", "s")]
    frame = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for shuffled in (frame, frame.orderBy(F.desc("source")).repartition(3)):
        kept = sorted(((r["doc_id"], r["text"], r["source"]) for r in pipeline.near_duplicates(spark, shuffled, DATA).collect()), key=str)
        assert kept == sorted([(1, None, "b"), (1, None, "a"), (2, "", "a"), (2, "", "a"), (3, " \n", "a"), (3, " \n", "a"), (4, prose, None), (6, "one", "s"), (6, "two", "s")], key=str)
