"""Personal data by bootstrapped contextual extraction.

Base patterns find the seed entities. The words around them induce lexical
patterns, and a graph joins patterns to instances, where an instance is an
identifier as a string, wherever it stands. It is scored in turns: a pattern is
trusted by the share of its instances that are known, an instance by all the
trusted patterns that it stands in, in any document. Instances that pass become
known everywhere, so that the next turn trusts further patterns, and confident
patterns discover identifiers that no base pattern matches. One more kind is
open: strings that mix letters and digits at length are seeds of secrets, for the
patterns' trust alone; like all others they are found only if patterns confirm
them. Everything is DataFrame code.

Java's regular expressions recurse on repeated groups and rescan long runs, so
inner separators are first replaced, one character for one, by a mark that a
plain character class can repeat.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, skew_join, text_of

KINDS = ("email", "ip", "card", "phone")
#: The kinds that the method may add.
FOUND_KINDS = (*KINDS, "secret")
#: Documents and instances that a pattern needs, its least trust, and the least score of an instance.
MIN_DOCUMENTS, MIN_TRUST, MIN_SCORE = 5, 0.6, 0.9
TURNS = 3
#: Least characters of a seed of secrets, and of a secret that a pattern discovers.
SEED_SECRET, LEAST_SECRET = 20, 8
#: Characters from which an instance is named by its hash.
LONGEST = 64
#: Characters of context before and after a word, as far as the next such word; a pattern has at most three words of it.
BEFORE, AFTER = 60, 30
#: Matches in one block of a running sum.
BLOCK = 64

_MARK = "\u0001"
#: The base patterns over marked text.
_EMAIL = rf"(?:(?<![A-Za-z0-9._%+{_MARK}-])|\G)[A-Za-z0-9._%+{_MARK}-]++@[A-Za-z0-9-]+{_MARK}[A-Za-z0-9{_MARK}-]+"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = rf"[0-9{_MARK}]{{2,}}"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: A word that may be an identifier: it has a digit or an at sign.
_WORDS = r"(?<!\S)(?=[^\s0-9@]*+[0-9@])\S++"
#: What stands around an identifier in its word.
_BEFORE, _AFTER = r"^[^\p{L}0-9+(]+", r"[^\p{L}0-9)]+$"


def _marked(text: Column, inner: str) -> Column:
    """``text`` with the separators that ``inner`` matches replaced by the mark."""
    return F.regexp_replace(F.translate(text, _MARK, "\u0002"), inner, _MARK)


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: a lambda's variable is not inlined."""
    return F.transform(F.array(value), use)[0]


def spans(text: Column, pattern: str, context: bool = False) -> Column:
    """Array of structs (start, end, found): leftmost matches, in code points.

    With ``context`` also (before, after): the text between matches near each.
    """
    near = ",before:string,after:string" if context else ""
    empty = F.array().cast(f"array<struct<start:int,end:int,found:string{near}>>")

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["g"])
        end = begin + F.length(p["f"])
        around = [F.right(p["g"], F.lit(BEFORE)).alias("before"), F.left(p["h"], F.lit(AFTER)).alias("after")] if context else []
        one = F.struct(begin.alias("start"), end.alias("end"), p["f"].alias("found"), *around)
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def place(pairs: Column) -> Column:
        # running sums in blocks, so that a text of many matches costs little more for each
        blocks = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int"))
        inside = lambda b: F.slice(pairs, b * BLOCK + 1, F.lit(BLOCK))
        sums = F.transform(blocks, lambda b: F.aggregate(inside(b), F.lit(0), lambda a, p: a + F.length(p["g"]) + F.length(p["f"])))
        starts = F.aggregate(sums, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

        def unfold(starts: Column) -> Column:
            first = lambda b: F.struct(F.get(starts, b).alias("at"), empty.alias("out"))
            return F.flatten(F.transform(blocks, lambda b: F.aggregate(inside(b), first(b), step, lambda acc: acc["out"])))

        return _bind(starts, unfold)

    def pair(found: Column) -> Column:
        def zipped(gaps: Column) -> Column:
            ends = [F.slice(gaps, F.lit(2), F.size(found)).alias("h")] if context else []
            return F.arrays_zip(found.alias("f"), F.slice(gaps, F.lit(1), F.size(found)).alias("g"), *ends)

        return F.when(F.size(found) > 0, _bind(_bind(F.split(text, pattern, -1), zipped), place)).otherwise(empty)

    return _bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), pair)


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    flipped = F.split(F.reverse(digits), "")

    def value(d: Column, i: Column) -> Column:
        n = F.coalesce(d.try_cast("int"), F.lit(0))
        twice = n * 2
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(n)

    return F.aggregate(F.transform(flipped, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind the array of its base spans: matches that fail their check are dropped."""
    digit = F.regexp_like(text, F.lit("[0-9]"))
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")
    dotted = _marked(text, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])")
    joined = _marked(text, r"(?<=[0-9])[ -](?=[0-9])")
    octet = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
    octets = lambda s: F.forall(F.split(s["found"], r"\."), octet)
    card = lambda s: F.length(_digits(s["found"])).between(13, 19) & luhn(_digits(s["found"]))
    phone = lambda s: F.length(_digits(s["found"])).between(9, 15)
    return {
        "email": F.when(F.contains(text, F.lit("@")), _bind(dotted, lambda t: spans(t, _EMAIL))).otherwise(none),
        "ip": F.when(digit & F.contains(text, F.lit(".")), F.filter(spans(text, _IP), octets)).otherwise(none),
        "card": F.when(digit, F.filter(_bind(joined, lambda t: spans(t, _CARD)), card)).otherwise(none),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(spans(text, _PHONE), phone)).otherwise(none),
    }


def _shape(core: Column) -> Column:
    """The kind that an identifier's own characters allow; null if none does."""
    n = F.length(_digits(core))
    return (
        F.when(F.regexp_like(core, F.lit(r"^[^@\s]+@[^@\s]*[\p{L}0-9]$")), "email")
        .when(F.regexp_like(core, F.lit(r"^(?=.*[0-9a-fA-F]:)[0-9a-fA-F:]{6,39}$")), "ip")
        .when(F.regexp_like(core, F.lit(r"^[0-9]([0-9 -]*)[0-9]$")) & n.between(13, 19), "card")
        .when(F.regexp_like(core, F.lit(r"^[+(]?[0-9][0-9().-]*[0-9]$")) & n.between(7, 15), "phone")
        .when(F.regexp_like(core, F.lit(rf"^(?=[^A-Za-z]*[A-Za-z])(?=[^0-9]*[0-9])[A-Za-z0-9+/=_.-]{{{LEAST_SECRET},}}$")), "secret")
    )


def _seed_secret(core: Column) -> Column:
    """Whether a string is a seed of secrets: long, with a fair share of letters and of digits."""
    n = F.length(_digits(core))
    return F.regexp_like(core, F.lit(rf"^[A-Za-z0-9+/=_-]{{{SEED_SECRET},}}$")) & (n * 6 >= F.length(core)) & (n * 6 <= F.length(core) * 5)


def occurrences(words: DataFrame) -> DataFrame:
    """``_row, start, end, node, kind, shape, seed, contexts`` of words (_row, start, end, found, kind, contexts).

    Words that begin a base span are that span, and have its kind. The identifier is the word without the marks around it; ``node`` names it without case.
    """
    begin = F.regexp_extract("found", _BEFORE, 0)
    core = F.regexp_replace(F.col("found").substr(F.length(begin) + 1, F.length("found")), _AFTER, "")
    cut_out = words.withColumn("start", F.col("start") + F.length(begin)).withColumn("core", core).withColumn("end", F.col("start") + F.length("core"))
    node = F.lower(F.when(F.length("core") <= LONGEST, F.col("core")).otherwise(F.sha2(F.lower("core").cast("binary"), 256)))
    return cut_out.filter("core <> ''").select("_row", "start", "end", node.alias("node"), "kind", _shape(F.col("core")).alias("shape"), _seed_secret(F.col("core")).alias("seed"), "contexts")


def discovered(found: DataFrame) -> DataFrame:
    """Spans ``_row, kind, start, end`` that trusted patterns add to the base ones; ``found`` are :func:`occurrences`.

    A pattern's instances are the different identifiers in its context; its trust
    in a kind is the share of them, with one added to the total, known as that
    kind. An instance's score is 1 less the product of the trusted patterns' doubt.
    Where a base pattern matches some occurrence of a string, it is known as that
    kind (of several, the first by name), and only its other occurrences are added.
    """
    nodes = cut(found.groupBy("node").agg(F.min("kind").alias("kind"), F.min("shape").alias("shape"), F.max("seed").alias("seed"), F.count(F.lit(1)).alias("times")))
    each = found.select("node", "_row", F.explode("contexts").alias("context"))
    pairs = cut(each.groupBy("node", "context").agg(F.count(F.lit(1)).alias("times")))
    docs = each.select("context", "_row").distinct().groupBy("context").agg(F.count(F.lit(1)).alias("docs"))
    sizes = pairs.groupBy("context").agg(F.count(F.lit(1)).alias("size"))
    able = docs.join(sizes, "context").filter((F.col("docs") >= MIN_DOCUMENTS) & (F.col("size") >= MIN_DOCUMENTS))
    total = max(1, pairs.count())
    edges = cut(skew_join(pairs.select("node", "context"), cut(able), "context", "size", total).select("node", "context", "size"))
    seeds = nodes.select("node", F.coalesce("kind", F.when(F.col("seed"), "secret")).alias("kind")).filter("kind is not null")
    open_ = nodes.filter("kind is null and shape is not null").select("node", "shape", F.col("seed").alias("seed"))
    known, news = cut(seeds), None
    for _ in range(TURNS):
        states = edges.join(known, "node")
        counted = states.groupBy("context", "kind").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
        best = counted.groupBy("context").agg(F.max(F.struct("n", "kind")).alias("best"), F.first("size").alias("size"))
        trusted = best.select("context", "size", F.col("best.kind").alias("of"), (F.col("best.n") / (F.col("size") + 1)).alias("trust")).filter(F.col("trust") >= MIN_TRUST)
        left = open_ if news is None else open_.join(news, "node", "left_anti")
        scored = skew_join(edges.drop("size").join(left, "node"), cut(trusted), "context", "size", total).filter("shape = of or (of = 'secret' and seed)")
        passed = (
            scored.groupBy("node", F.col("of").alias("kind"))
            .agg((1 - F.exp(F.sum(F.log(F.lit(1.0) - F.least("trust", F.lit(0.999)))))).alias("score"))
            .filter(F.col("score") >= MIN_SCORE)
            .groupBy("node").agg(F.max(F.struct("score", "kind")).alias("best")).select("node", F.col("best.kind").alias("kind"))
        )
        fresh = cut(passed)
        if fresh.isEmpty():
            break
        news = fresh if news is None else news.unionByName(fresh)
        known = cut(known.join(fresh, "node", "left_anti").unionByName(fresh))
    base = nodes.filter("kind is not null").select("node", "kind")
    named = (base if news is None else base.unionByName(news)).join(nodes.select("node", "times"), "node")
    free = found.filter("kind is null").select("_row", "node", "start", "end")
    return skew_join(free, cut(named), "node", "times", max(1, free.count())).select("_row", "kind", "start", "end")


def _tagged(kind: str, found: Column) -> Column:
    return F.transform(found, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _of_kind(found: Column, kind: str) -> Column:
    return F.filter(found, lambda s: s["kind"] == kind)


def _as_text(found: Column, kind: str) -> Column:
    own = F.array_sort(F.transform(_of_kind(found, kind), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return F.transform(own, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, counts of base spans, all spans, and the method's own.

    ``base`` and ``added`` are arrays of (kind, start, end), offsets in code
    points, ends exclusive. Null or empty text has no spans; repeated rows each
    keep theirs; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kinds = base_spans(F.col("text"))
    tagged = [_tagged(kind, found) for kind, found in kinds.items()]
    based = rows.withColumn("base", F.concat(*tagged)).withColumn("_row", F.monotonically_increasing_id())
    # only rows with a span or a possible identifier carry more than their empty result
    slim = cut(_based_with_words(based))
    words = slim.select("_row", F.explode("words").alias("w")).select("_row", "w.*")
    added = discovered(cut(occurrences(words)))
    grouped = added.groupBy("_row").agg(F.sort_array(F.collect_set(F.struct("kind", "start", "end"))).alias("added"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return slim.drop("words").join(grouped, "_row", "left").withColumn("added", F.coalesce("added", none)).drop("_row")


def _based_with_words(based: DataFrame) -> DataFrame:
    """``based`` without its text, with the candidate words as an array column."""
    text = F.col("text")
    clean = lambda c: F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\s=:#]", ""), r"\s+"), lambda x: x != "")

    def word(w: Column) -> Column:
        left, right = clean(w["before"]), clean(w["after"])
        touching = F.filter("base", lambda b: (b["start"] < w["end"]) & (b["end"] > w["start"]))

        def contexts(left: Column) -> Column:
            last = F.try_element_at(left, F.lit(-1))
            return F.array_compact(F.array(
                F.concat(F.lit("1:"), last),
                F.concat(F.lit("2:"), F.try_element_at(left, F.lit(-2)), F.lit(" "), last),
                F.concat(F.lit("3:"), last, F.lit(" _ "), F.get(right, F.lit(0))),
            ))

        def named(touching: Column) -> Column:
            base = F.get(touching, F.lit(0))
            # the word where a base span begins stands for the span, the words after it for nothing
            whole = F.when(base["start"] >= w["start"], text.substr(base["start"] + 1, base["end"] - base["start"]))
            return F.struct(
                F.coalesce(base["start"], w["start"]).alias("start"), F.coalesce(base["end"], w["end"]).alias("end"),
                F.when(base.isNull(), w["found"]).otherwise(whole).alias("found"), base["kind"].alias("kind"),
                F.flatten(F.transform(F.array(left), contexts)).alias("contexts"),
            )

        return _bind(touching, named)

    none = F.array().cast("array<struct<start:int,end:int,found:string,kind:string,contexts:array<string>>>")
    some = F.filter(F.transform(spans(text, _WORDS, context=True), word), lambda w: w["found"].isNotNull())
    return based.withColumn("words", F.when(F.regexp_like(text, F.lit("[0-9@]")), some).otherwise(none)).drop("text")


def digest(found: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text, by kind and start."""

    listed = lambda spans: F.array_join(F.concat(*[_as_text(spans, k) for k in FOUND_KINDS]), ",")
    count = lambda k: F.size(_of_kind(F.col("base"), k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *[count(k) for k in KINDS],
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
    )
