"""Secret scan: candidates by pattern, false positives removed by a random forest, in SQL functions alone.

A candidate is a long run of key characters with a digit. The forest judges it by
its length, the transitions between its characters, how much of it dictionary
words cover, path marks in and around it, and the words beside it. It is trained on
labelled findings (a table of candidates with their surroundings) and applied as
an SQL expression, so a scan is one pass over the texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm._shared import fresh, pick

_RUN = "[A-Za-z0-9_+/-]"
CANDIDATE = rf"(?<!{_RUN})(?=[A-Za-z_+/-]*+[0-9]){_RUN}{{12,}}+={{0,2}}"
THRESHOLD = 0.5
BESIDE = 32
MASK = "<SECRET>"
TREES, DEPTH, SEED = 24, 6, 7
#: Rows of the labelled findings that are made when none are given.
LABELLED = 6_000

#: Words and word parts of names, prose and paths.
DICTIONARY = (
    "the", "and", "for", "with", "tion", "ing", "ment", "able", "connection", "version", "release", "image", "header", "large", "small", "final",
    "notes", "page", "site", "packages", "python", "java", "lib", "usr", "local", "share", "home", "data", "file", "test", "build", "http", "https",
    "get", "set", "pool", "user", "name", "config", "module", "index", "report", "draft", "chapter", "section", "table", "figure", "change", "example",
    "password", "number", "order", "server", "client", "backup", "january", "march", "summer", "winter", "default", "main", "update", "utils",
)
_SECRET_WORDS = "token|secret|passw|passwd|pwd|api.?key|access.?key|private.?key|auth|credential|bearer|client.?secret"
_PLAIN_WORDS = "commit|sha1|sha256|md5|checksum|digest|hash|uuid|guid|id|build|version|isbn|phone|tel|order|card|invoice|revision|etag|file|path|image|img|href|src"
_PREFIX = "^(AKIA|ASIA|gh[pousr]_|glpat-|xox[abprs]-|sk_live_|rk_live_|AIza|eyJ|npm_)"


def features(value: Column, before: Column, after: Column) -> list[Column]:
    """What the forest sees of a candidate and the text on either side."""
    size = F.length(value).cast("double")
    low, lead = F.lower(value), F.lower(before)
    share = lambda p: F.regexp_count(value, F.lit(p)) / size
    beside = lambda words: lead.rlike(rf"(?:{words})[a-z_]{{0,10}}[\"']?\s{{0,3}}[=:]?\s{{0,3}}[\"'(]?$").cast("double")
    return [
        size,
        share("[0-9]"),
        share("[A-Z]"),
        share("[a-z]"),
        value.rlike("^[0-9a-f]+$").cast("double"),
        F.size(F.array_distinct(F.split(value, ""))) / F.least(size, F.lit(36.0)),
        share("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"),
        share("(?<=[a-z])(?=[A-Z])"),
        F.regexp_count(low, F.lit("(?<=[aeiou])(?=[b-df-hj-np-tv-z])")) / size,
        F.lit(1.0) - F.length(F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), "")) / size,
        share("[/_-]"),
        (before.rlike(r"[/.\\@~]$") | after.rlike(r"^(?:\.[a-z]|[@/\\])")).cast("double"),
        beside(_SECRET_WORDS),
        beside(_PLAIN_WORDS),
        value.rlike(_PREFIX).cast("double"),
        before.rlike(r"[=:]\s?[\"']?$").cast("double"),
    ]


def labelled_findings(spark: SparkSession, n: int = LABELLED, seed: int = SEED) -> DataFrame:
    """``before, value, after, label``: made-up findings as a reviewer would have labelled them, the same each time.

    Keys of several services and random passwords in the places where they are
    found; and what a scan mistakes for them: card and phone numbers, digests,
    identifiers, paths, names, dates and placeholders.
    """
    i = F.col("id")
    hexes = lambda k: F.sha2(F.concat_ws("/", F.lit(f"{seed}{k}"), i.cast("string")), 512)
    alnum = lambda k: F.translate(F.base64(F.unhex(hexes(k))), "+/=\r\n", "xY")
    digits = lambda k: F.regexp_replace(hexes(k), "[a-f]", "")
    cut = lambda c, n: F.substring(c, 1, n)
    pick1 = lambda k, xs: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.xxhash64(i, F.lit(f"{seed}/{k}")), F.lit(len(xs))) + 1).cast("int"))
    words = lambda k: pick1(k, ["update", "report", "chapter", "version", "image", "header", "server", "release", "thing", "notes", "summer", "module"])
    prose = pick1("prose", ["the other one was ", "as one of them, ", "in and of the ", "und die ", "que les ", "de los que ", "see also ", "\n"])
    quote = pick1("quote", ['"', "'", ""])
    named = lambda xs: F.concat(prose, pick1("name", xs), pick1("eq", [" = ", "=", ": "]), quote)
    secret = named(["token", "secret", "password", "api_key", "apikey", "auth_token", "client_secret", "passwd", "access_key", "credential"])
    plain = F.concat(prose, pick1("what", ["commit ", "sha256:", "md5 ", "checksum: ", "uuid ", "id=", "etag: ", "revision ", "build ", ""]))
    yes = [
        (secret, cut(hexes("a"), 40)), (secret, cut(hexes("b"), 18)), (prose, F.concat(F.lit("AKIA"), cut(F.upper(alnum("c")), 16))),
        (secret, cut(hexes("d"), 32)), (secret, cut(alnum("e"), 40)), (pick1("gh", ["", "use "]), F.concat(F.lit("ghp_"), cut(alnum("f"), 36))),
        (F.concat(prose, F.lit("Authorization: Bearer ")), F.concat(F.lit("eyJ"), cut(alnum("g"), 60))), (secret, cut(alnum("h"), 24)),
        (secret, F.concat(F.lit("AKIA"), cut(F.upper(alnum("i")), 16))), (secret, cut(alnum("j"), 16)),
    ]
    date = F.date_format(F.date_add(F.lit("2015-01-01").cast("date"), F.pmod(i, F.lit(3000)).cast("int")), "yyyyMMdd")
    no = [
        (prose, cut(digits("k"), 16)), (prose, cut(digits("l"), 13)), (plain, cut(hexes("m"), 40)), (plain, cut(hexes("n"), 64)), (plain, cut(hexes("o"), 32)),
        (plain, F.regexp_replace(cut(hexes("p"), 32), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")),
        (prose, F.concat(F.lit("/usr/lib/"), words("q"), F.lit("3/site-packages/"), words("r"))), (prose, F.concat(words("s"), F.lit("2"), F.initcap(words("t")), F.lit("Connection"))),
        (prose, F.concat(date, F.lit("-"), cut(digits("u"), 6), F.lit("-"), words("v"))), (prose, F.concat(words("w"), F.lit("_2023_"), words("x"), F.lit("_large"))),
        (secret, F.concat(F.lit("change-me-"), cut(digits("y"), 4))), (prose, F.concat(F.repeat(pick1("z", ["x", "-", "0"]), 14), cut(digits("z"), 2))),
        (F.concat(prose, F.lit("https://example.com/")), F.concat(words("A"), F.lit("/"), cut(digits("A"), 5), F.lit("-"), words("B"))),
        (named(["order", "invoice", "phone", "isbn", "id"]), cut(digits("B"), 14)), (prose, F.concat(words("C"), F.lit("-"), words("D"), F.lit("-v2-"), words("E"))),
    ]
    turn = F.floor(i / 2)
    kind = lambda xs, at: F.element_at(F.array(*(x[at] for x in xs)), (F.pmod(turn, F.lit(len(xs))) + 1).cast("int"))
    label = (i % 2).cast("int")
    return spark.range(0, n, 1, 4).select(
        F.when(label == 1, kind(yes, 0)).otherwise(kind(no, 0)).alias("before"),
        F.when(label == 1, kind(yes, 1)).otherwise(kind(no, 1)).alias("value"),
        pick1("after", ['"', " and so on", "", ".", "\n", "' or"]).alias("after"),
        label.alias("label"),
    )


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> Callable[[Column], Column]:
    """Fit the forest to labelled findings; the result maps an array of features to the share of secrets among like findings."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    values = F.array(*(f.cast("double") for f in features(F.col("value"), F.col("before"), F.col("after"))))
    rows = findings.select(array_to_vector(values).alias("features"), F.col("label").cast("double").alias("label"))
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(rows)

    def sql(node: object) -> str:
        if node.subtreeDepth() == 0:
            stats = list(node.impurityStats().stats())
            return f"{stats[1] / max(sum(stats), 1e-9)!r}D"
        split = node.split()
        return f"CASE WHEN f[{split.featureIndex()}] <= {float(split.threshold())!r}D THEN {sql(node.leftChild())} ELSE {sql(node.rightChild())} END"

    trees_sql = [sql(t._call_java("rootNode")) for t in model.trees]  # noqa: SLF001
    total = " + ".join(f"({t})" for t in trees_sql)
    return lambda f: F.element_at(F.transform(F.array(f), _lambda_of(total, len(trees_sql))), 1)


def _lambda_of(total: str, n: int) -> Callable[[Column], Column]:
    """The sum of the trees as a lambda of SQL whose variable is ``f``."""

    def apply(x: Column) -> Column:
        return F.call_function("aggregate", F.array(x), F.lit(0.0), F.expr(f"(s, f) -> ({total}) / {n}.0D"))

    return apply


def _parts(text: Column) -> Column:
    """The text cut before and after each candidate; candidates are the elements at odd places. U+0001 and U+0002 are escaped."""
    safe = F.replace(F.replace(text, F.lit("\u0002"), F.lit("\u0002b")), F.lit("\u0001"), F.lit("\u0002a"))
    return F.split(F.regexp_replace(safe, CANDIDATE, "\u0001$0\u0001"), "\u0001", -1)


def _plain(part: Column) -> Column:
    return F.replace(F.replace(part, F.lit("\u0002a"), F.lit("\u0001")), F.lit("\u0002b"), F.lit("\u0002"))


def _judged(score: Callable[[Column], Column], parts: Column) -> Column:
    """``place, value, score`` of each candidate among the parts of a text."""
    places = F.when(F.size(parts) > 2, F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)))

    def seen(i: Column) -> Column:
        value, before, after = parts[i], F.right(parts[i - 1], F.lit(BESIDE)), F.left(parts[i + 1], F.lit(BESIDE))
        return F.struct(i.alias("place"), value.alias("value"), F.array(*(f.cast("double") for f in features(value, before, after))).alias("f"))

    return F.transform(F.transform(places, seen), lambda s: F.struct(s["place"].alias("place"), s["value"].alias("value"), score(s["f"]).alias("score")))


#: Parts whose lengths are summed one by one; beyond, by blocks of so many.
BLOCK = 128


def _sum(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, n: a + n)


def _bases(lengths: Column) -> Column:
    """Where each block of parts begins."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int"))
    return F.aggregate(blocks, F.array(F.lit(0)), lambda a, b: F.array_append(a, F.element_at(a, -1) + _sum(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))))


def _start(lengths: Column, bases: Column, place: Column) -> Column:
    block = F.floor(place / BLOCK).cast("int")
    return F.element_at(bases, block + 1) + _sum(F.slice(lengths, block * BLOCK + 1, place % BLOCK))


def _score(docs: DataFrame, findings: DataFrame | None) -> Callable[[Column], Column]:
    return train(findings if findings is not None else labelled_findings(docs.sparkSession))


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, start, n_chars, shown, value_sha256, score, is_secret`` of every candidate in every whole text.

    ``start`` counts characters from 0; ``shown`` is the first four of them. Null
    and empty texts have no candidates; a null ``doc_id`` stays; repeated rows
    show their candidates each; an empty table gives an empty one; other columns
    aren't read. ``findings`` replaces the made-up labelled findings.
    """
    rows = pick(docs, doc_id="long", text="string").select("doc_id", _parts(F.col("text")).alias("parts")).where(F.size("parts") > 1)
    rows = rows.withColumn("lengths", F.transform("parts", lambda p: F.length(_plain(p)))).withColumn("bases", _bases(F.col("lengths")))
    rows = rows.select("doc_id", "lengths", "bases", _judged(_score(docs, findings), F.col("parts")).alias("found"))
    placed = F.transform("found", lambda x: F.struct(x.alias("x"), _start(F.col("lengths"), F.col("bases"), x["place"]).alias("start")))
    # an inner explode would have the optimizer cut the text again for each candidate, to see which rows have any
    rows = rows.select("doc_id", F.explode_outer(placed).alias("y")).where("y is not null").select("doc_id", "y.*")
    return rows.select(
        "doc_id", F.col("start").cast("long").alias("start"), F.length("x.value").cast("long").alias("n_chars"), F.substring("x.value", 1, 4).alias("shown"),
        F.sha2("x.value", 256).alias("value_sha256"), F.col("x.score").alias("score"), (F.col("x.score") >= threshold).alias("is_secret"),
    )


def redact(docs: DataFrame, findings: DataFrame | None = None, threshold: float = THRESHOLD, mask: str = MASK) -> DataFrame:
    """The documents, every column kept, with ``mask`` in place of each secret of ``text``, and ``n_chars`` (if there) to match.

    Null and empty texts stay as they are; repeated rows are masked alike; an empty
    table gives an empty one; columns of any other name pass through.
    """
    parts, secret, text = (fresh(c, docs.columns) for c in ("__parts", "__secret", "__text"))
    rows = docs.withColumn(parts, _parts(F.col("text").cast("string")))
    rows = rows.withColumn(secret, F.transform(_judged(_score(docs, findings), F.col(parts)), lambda s: s["score"] >= threshold))
    hit = lambda i: (i % 2 == 1) & F.element_at(secret, F.when(i % 2 == 1, ((i + 1) / 2).cast("int")).otherwise(1))
    masked = F.array_join(F.transform(F.col(parts), lambda p, i: F.when(hit(i), F.lit(mask)).otherwise(_plain(p))), "")
    rows = rows.withColumn(text, F.when(F.exists(secret, lambda s: s), masked).otherwise(F.col("text")))
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return rows.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns))
