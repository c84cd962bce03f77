"""Personal data by bootstrapped contextual extraction.

Base spans come from four patterns and their checks; they always stay. They also seed
the bootstrap, and so do long hexadecimal strings, seeds of a fifth kind, secrets. The
words around each occurrence of an identifier are lexical patterns, and patterns and
instances (identifier strings) form a graph. In each round a pattern's confidence for a
kind is the mean score of its distinct instances, counting everything identifier-like in
its slot; it is strong if enough of them are sure by then, seeds or not. An instance that
isn't a seed gets the noisy-or of its strong patterns, so what was found in one round
makes patterns strong in the next. Patterns that end confident give spans to instances of
a fitting shape. A secret is a span only where such a pattern says so, a seed too: a
string of digits and letters alone doesn't tell.

DataFrame expressions only. Regular expressions are written with possessive
quantifiers and a look at the character before, so a long run costs linear time and
no stack. An array of matches and an array of what lies between them give positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annoweave.llm.base import cut, row_hash, text_of

#: In the order in which spans with one start are listed.
KINDS = ("email", "ip", "card", "phone")
#: The kinds that the bootstrap gives spans of.
ALL_KINDS = (*KINDS, "secret")
_LOCAL = "A-Za-z0-9._%+-"
#: The same matches as the plain patterns, found in linear time.
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Without these a text has no match of the kind.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Whatever looks like an identifier, the base kinds included.
LIKELY = "|".join([
    rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+",
    r"(?<![A-Za-z0-9])[0-9]++(?:\.[0-9]++){3}+",
    r"(?<![A-Za-z0-9])\+?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9])\([0-9](?:[\x20().-]{0,2}[0-9]){6,}+(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9])[A-Za-z]++[0-9][A-Za-z0-9]*+",
    r"(?<![A-Za-z0-9])[0-9]++[A-Za-z][A-Za-z0-9]*+",
])
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: Characters on either side in which context words are looked for. A word that reaches
#: beyond isn't a context word: it would be cut.
REACH = 64
#: Occurrences of a confident pattern are dealt into so many parts, whatever their number.
SALT = 32
ROUNDS = 3
MIN_CONFIDENCE = 0.9
MIN_SEEDS = 3


def found(text: Column, pattern: str, needs: str) -> tuple[Column, Column]:
    """(matches, lengths and edges of what lies between) as arrays."""
    there = text.rlike(needs)
    # where the text goes on beyond the reach, what is left of a cut word goes
    tail = lambda p: F.when(F.length(p) > REACH, F.regexp_replace(F.right(p, F.lit(REACH)), r"^\S++", "")).otherwise(p)
    head = lambda p: F.when(F.length(p) > REACH, F.regexp_replace(F.left(p, F.lit(REACH)), r"(?<!\S)\S++$", "")).otherwise(p)
    edge = lambda p: F.struct(F.length(p).alias("n"), tail(p).alias("tail"), head(p).alias("head"))
    none = F.array().cast("array<string>")
    return (
        F.when(there, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none),
        F.transform(F.when(there, F.split(text, pattern, -1)).otherwise(none), edge),
    )


def placed(matches: Column, between: Column) -> Column:
    """array<struct<s, e, x, tail, head>>: code-point spans of the matches with their surroundings."""
    empty = F.array().cast("array<struct<s:bigint,e:bigint,x:string,tail:string,head:string>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))

    def step(acc: Column, i: Column) -> Column:
        gap, x = F.get(between, i), F.get(matches, i)
        s = acc["at"] + gap["n"]
        e = s + F.length(x)
        span = F.struct(s.alias("s"), e.alias("e"), x.alias("x"), gap["tail"].alias("tail"), F.get(between, i + 1)["head"].alias("head"))
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    # sequence(0, -1) would count down
    indices = F.filter(F.sequence(F.lit(0), F.greatest(F.size(matches) - 1, F.lit(0))), lambda i: i < F.size(matches))
    return F.aggregate(indices, start, step, lambda acc: acc["out"])


def luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: str, x: Column) -> Column:
    """The checks on a base match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return x.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        digits = F.translate(x, " -", "")
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    return F.length(F.regexp_replace(x, "[^0-9]", "")).between(9, 15)


def fits(kind: str, x: Column) -> Column:
    """Whether a string could be an identifier of the kind in another spelling."""
    digits = F.length(F.regexp_replace(x, "[^0-9]", ""))
    if kind == "email":
        return x.contains("@")
    if kind == "ip":
        return x.rlike(r"^[0-9]+(?:\.[0-9]+){3}$")
    if kind == "card":
        return x.rlike(r"^[0-9 -]+$") & digits.between(12, 19)
    if kind == "secret":
        return x.rlike(r"^(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9]{16,}$")
    return x.rlike(r"^[0-9 ().+-]+$") & ~x.rlike(r"^[0-9]+(?:\.[0-9]+){3}$") & digits.between(7, 15)


def seed_kind(x: Column) -> Column:
    """The kind of which a string is a whole base match, secret for long hexadecimal ones, or null."""
    whole = {"email": rf"^[{_LOCAL}]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$", "ip": r"^[0-9]+(?:\.[0-9]+){3}$", "card": r"^[0-9](?:[ -]?[0-9])++$", "phone": r"^\+[0-9][ ().0-9-]+[0-9]$"}
    secret = x.rlike(r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$") & fits("secret", x)
    return F.coalesce(*[F.when(x.rlike(whole[k]) & valid(k, x), F.lit(k)) for k in KINDS], F.when(secret, F.lit("secret")))


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, base, likely) with arrays of spans."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_hash(text_col).alias("text_hash"), text_of(text_col).alias("t"))
    cols = []
    for k in KINDS:
        m, b = found(F.col("t"), BASE[k], NEEDS[k])
        cols += [m.alias(f"m_{k}"), b.alias(f"b_{k}")]
    m, b = found(F.col("t"), LIKELY, "[0-9@]")
    d = d.select("doc_id", "text_hash", *cols, m.alias("m_likely"), b.alias("b_likely"))

    def spans(n: int, kind: str) -> Column:
        checked = F.filter(placed(F.col(f"m_{kind}"), F.col(f"b_{kind}")), lambda s: valid(kind, s["x"]))
        return F.transform(checked, lambda s: F.struct(s["s"].alias("s"), F.lit(n).alias("n"), s["e"].alias("e"), F.lit(kind).alias("kind")))

    base = F.concat(*[spans(n, k) for n, k in enumerate(KINDS)])
    return d.select("doc_id", "text_hash", F.array_sort(base).alias("base"), placed(F.col("m_likely"), F.col("b_likely")).alias("likely"))


def lexical_patterns(tail: Column, head: Column) -> Column:
    """Patterns of an occurrence: the word or two words before it, the two after it, and the words on both sides.

    Words are in lower case with digits as 0, so that they are shapes as far as figures
    go. A side without a word (the text's edge or another identifier) takes part as an
    empty word on both sides; a pattern needs as many words as it names otherwise.
    """
    plain = lambda c: F.regexp_replace(F.lower(c), "[0-9]", "0")
    before = F.filter(F.split(plain(tail), r"\s+"), lambda w: w != "")
    after = F.filter(F.split(plain(head), r"\s+"), lambda w: w != "")
    word = lambda ws, i: F.coalesce(F.when(F.size(ws) >= abs(i), F.element_at(ws, i)), F.lit(""))
    last, earlier, nxt, later = word(before, -1), word(before, -2), word(after, 1), word(after, 2)
    named = lambda name, *ws: F.concat_ws(" ", F.lit(name), *ws)
    return F.filter(
        F.array(
            F.when(last != "", named("word", last)),
            F.when(earlier != "", named("before", earlier, last)),
            F.when(later != "", named("after", nxt, later)),
            F.when(F.concat(last, nxt) != "", named("around", last, nxt)),
        ),
        lambda p: p.isNotNull(),
    )


def _by_kind(kind: Column, make) -> Column:
    return F.coalesce(*[F.when(kind == k, make(k, i)) for i, k in enumerate(ALL_KINDS)])


def graph(seen: DataFrame) -> DataFrame:
    """(pattern, instance, kind, is_seed, open): each instance once for a pattern and a kind.

    An instance that could be of the kind by its shape is open, unless it is a seed of any.
    """
    edges = seen.select(F.explode("ps").alias("pattern"), "instance", "x", "seed").groupBy("pattern", "instance").agg(F.first("x").alias("x"), F.first("seed").alias("seed"))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(F.col("seed") == k, F.lit(False)).alias("is_seed"), (F.col("seed").isNull() & fits(k, F.col("x"))).alias("open")) for k in ALL_KINDS]))
    return edges.select("pattern", "instance", kinds.alias("k")).select("pattern", "instance", "k.*")


def confident_patterns(edges: DataFrame, rounds: int, min_confidence: float, min_seeds: int) -> DataFrame:
    """(pattern, kind, conf) of the patterns that are confident after the last round, iterated over the graph."""
    # a pattern no slot of which could ever hold enough of a kind takes no part for it
    able = edges.groupBy("pattern", "kind").agg(F.count_if(F.col("is_seed") | F.col("open")).alias("n")).filter(F.col("n") >= min_seeds)
    edges = cut(edges.join(able.select("pattern", "kind"), ["pattern", "kind"]))
    scored = edges.withColumn("score", F.col("is_seed").cast("double"))
    for n in range(rounds):
        stats = scored.groupBy("pattern", "kind").agg(F.avg("score").alias("conf"), F.count_if(F.col("score") >= min_confidence).alias("sure"))
        strong = stats.filter(F.col("sure") >= min_seeds)
        if n + 1 == rounds:
            return strong.filter(F.col("conf") >= min_confidence).select("pattern", "kind", "conf")
        # noisy-or over the strong patterns that are half sure: one that isn't certain yet may still raise its instances
        votes = edges.join(strong.filter("conf >= 0.5").select("pattern", "kind", "conf"), ["pattern", "kind"])
        raised = votes.filter("open").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("conf", F.lit(0.999)))))).alias("raised"))
        scored = cut(edges.join(raised, ["instance", "kind"], "left").withColumn("score", F.when(F.col("is_seed"), 1.0).otherwise(F.coalesce("raised", F.lit(0.0)))).drop("raised"))
    raise ValueError("rounds must be positive")


def bootstrap(marked: DataFrame, rounds: int = ROUNDS, min_confidence: float = MIN_CONFIDENCE, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """(doc_id, text_hash, s, e, kind) of the spans that confident patterns give."""
    seen = marked.select("doc_id", "text_hash", F.explode("likely").alias("o")).select(
        "doc_id", "text_hash", "o.s", "o.e", "o.x", seed_kind(F.col("o.x")).alias("seed"), lexical_patterns(F.col("o.tail"), F.col("o.head")).alias("ps")
    )
    seen = cut(seen.withColumn("instance", F.xxhash64("x")))
    confident = confident_patterns(graph(seen), rounds, min_confidence, min_seeds)
    # a common pattern's occurrences are dealt into parts, each of which meets the pattern's one row
    parts = confident.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    new = seen.filter(F.col("seed").isNull() | (F.col("seed") == "secret")).select("doc_id", "text_hash", "s", "e", "x", F.explode("ps").alias("pattern"))
    hits = new.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash", "s"), F.lit(SALT)).cast("int")).join(parts, ["pattern", "salt"])
    hits = hits.filter(_by_kind(F.col("kind"), lambda k, _: fits(k, F.col("x"))))
    # of several kinds the most confident, then the first listed
    rank = _by_kind(F.col("kind"), lambda _, i: F.lit(-i))
    return hits.groupBy("doc_id", "text_hash", "s", "e").agg(F.max_by("kind", F.struct("conf", rank)).alias("kind"))


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["s"].cast("string"), s["e"].cast("string"))))


def find_pii(docs: DataFrame, rounds: int = ROUNDS, min_confidence: float = MIN_CONFIDENCE, min_seeds: int = MIN_SEEDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data in each row's whole text.

    Base spans are leftmost and non-overlapping within a kind; spans of different kinds
    may overlap. Spans that the bootstrap adds never overlap base spans. Positions are
    code points, ends exclusive. Null text is empty and has no spans; a null id is kept;
    repeated rows stay repeated. A very long text is read to its end, in time and memory
    in proportion to it. An empty table gives no rows; other columns are ignored.

    Returns doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans,
    n_added (spans of the bootstrap), n_secret (those of them that are secrets), n_spans.
    """
    marked = cut(mark(docs, id_col, text_col))
    added = bootstrap(marked, rounds, min_confidence, min_seeds)
    number = _by_kind(F.col("kind"), lambda _, i: F.lit(i))
    by_doc = added.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.collect_list(F.struct("s", number.alias("n"), "e", "kind")).alias("more"))
    both = marked.select("doc_id", "text_hash", "base").join(by_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    clear = F.filter(
        F.coalesce("more", F.array().cast("array<struct<s:bigint,n:int,e:bigint,kind:string>>")),
        lambda m: ~F.exists("base", lambda b: (b["s"] < m["e"]) & (m["s"] < b["e"])),
    )
    out = both.select("doc_id", "base", clear.alias("more"))
    count = lambda of, k: F.size(F.filter(of, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select(
        "doc_id",
        *[count("base", k) for k in KINDS],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base", "more"))).alias("spans"),
        F.size("more").cast("long").alias("n_added"),
        count("more", "secret"),
        (F.size("base") + F.size("more")).cast("long").alias("n_spans"),
    )
