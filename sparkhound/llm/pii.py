"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are exact recognisers for e-mail addresses, IP addresses, card and phone numbers. Looser recognisers give candidates
that only *might* be such identifiers: written-out addresses, compressed IPv6 addresses, any run of digits and separators.
An occurrence of either stands in lexical contexts, literal ones and patterns over them:
  * the word before it (or the label that is glued to it), the two words before it, the word after it;
  * L: the class of the label before it, which is its letters without case, digits and outer punctuation ('Tel.:', '(tel');
  * W: the class of the word two before it, whatever word stands between ('hotline anna +49...');
  * P: the class of the word after it.
Words are known by their last ``WIDTH`` characters; a word after that ends beyond them is no context. Seeds and contexts
form a bipartite graph that Spark scores in turns:
  * a context's score is the share of all its corpus occurrences that have an identifier of the kind in their slot, each
    weighted by the instance's current belief, if at least ``SUPPORT`` different instances stand there;
  * a candidate's belief is 1 - (1 - before) * (1 - after), the best scores of its contexts on either side that reach
    ``TRUST`` (forms of one side are the same evidence); seeds keep belief 1.
Candidates that overlap a seed take no part. Corpus counts are made only if some context has ``SUPPORT`` seeds, as nothing
is trusted otherwise: of the distinct words, and of word pairs only where a pair can reach ``SUPPORT``.
Instances that come to be believed induce further contexts in the next turn, until in two turns no further context reaches
``TRUST`` and the scores hardly rise. Then candidates in trusted contexts are reported beside the seeds, which are never dropped.

Offsets count code points. ``split`` and ``regexp_extract_all`` use the same engine and pattern, so gaps and matches
alternate and a running sum of their lengths gives the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import forget, keep, numbered, unpacked

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 5
TRUST = 0.5
#: Turns at most; more raise an error. Scores only rise, so they settle.
ROUNDS = 50

#: Possessive forms of the contract's patterns. A match can start inside a run of its first class only where another one
#: ended (\G); else the run's first character would have started it. So each run is tried once and time stays linear.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A separator that joins no two digits becomes a line feed (a hyphen \x01), one for one; digit chains are then runs of one class.
NOT_CHAIN = r"(?<![0-9])[\x20-]|[\x20-](?![0-9])"
CHAIN = r"[0-9\x20-]{2,}+"
#: Where an identifier can begin inside a word, after a label: 'tel:+49...', '<a@b.c', 'no7'.
GLUED = r"(?<=[^0-9a-z])(?=[0-9a-z+(])|(?<=[^0-9+(])(?=[0-9+(])"
#: Characters of a context at most, its last ones.
WIDTH = 48
#: Candidates only.
_SPELT = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(][aA][tT][\])] ?[A-Za-z0-9-]{1,63}+(?: ?(?:[\[(][dD][oO][tT][\])]|\.) ?[A-Za-z0-9-]{1,63}+){1,8}"
#: Addresses with letters of any script; those of ASCII letters alone are seeds.
_ANY_SCRIPT = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+){1,8}+"
LOOSE_EMAIL = f"{_SPELT}|{_ANY_SCRIPT}"
_HEX = "[0-9A-Fa-f]{1,4}+"
LOOSE_IP = rf"(?<![0-9A-Za-z:.])(?:(?:{_HEX}:){{3,7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|::(?:{_HEX}:){{0,6}}{_HEX})(?![0-9A-Za-z:])"
#: Two to six groups of digits, or one run; a full stop or a hyphen may follow, but no further digit.
LOOSE_PHONE = r"(?<![0-9+(.-])(?:\(?[0-9]{2,5}+\)?(?:[\x20./-]{1,2}+[0-9]{2,8}+){1,5}+|[0-9]{7,15}+)(?![0-9]|[.-][0-9])"
LOOSE_DIGITS = (7, 15)
BLANKS = "\t\n\x0b\x0c\r "


def _found(kind: str, seed: bool, text: Column, pattern: str, if_: Column) -> Column:
    """struct(kind, seed, matches, gaps): matches of a pattern and the texts before, between and behind them."""
    matches = F.when(if_, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return F.struct(F.lit(kind).alias("kind"), F.lit(seed).alias("seed"), matches.alias("matches"), F.when(if_, F.split(text, pattern, -1)).alias("gaps"))


def _surroundings(matches: Column, gaps: Column) -> Column:
    """For each match: itself, the length of the gap before it, the last characters before it and the first ones after it."""
    shown = lambda x: F.translate(x, "\x01", "-")
    before = lambda k: F.concat(F.when(k > 0, F.get(matches, k - 1)).otherwise(F.lit("")), F.get(gaps, k))
    return F.transform(
        matches,
        lambda x, k: F.struct(
            x.alias("match"), F.length(F.get(gaps, k)).alias("gap"), shown(F.right(F.rtrim(before(k), F.lit(BLANKS)), F.lit(WIDTH))).alias("tail"),
            shown(F.right(F.get(gaps, k), F.lit(1))).rlike(r"^[\x09-\x0D\x20]").alias("apart"), shown(F.left(F.get(gaps, k + 1), F.lit(WIDTH))).alias("head"),
        ),
    )


def _class(word: Column) -> Column:
    """A lower-case word without what is no letter at its ends, runs of digits as 0; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(word, r"^[^\p{L}]++|(?<=\p{L})[^\p{L}]++$", ""), "[0-9]++", "0"), F.lit(""))


def _contexts() -> Column:
    """The word before (or the label glued to) a match, 'two words before' marked 2, 'the word after' marked R, and their
    classes marked L, W and P; whole words only."""
    words, after = F.split(F.lower(F.col("m.tail")), r"[\x09-\x0D\x20]+"), F.split(F.lower(F.col("m.head")), r"[\x09-\x0D\x20]+")
    whole = (F.size(words) > 2) | (F.size(words) == 2) & (F.length("m.tail") < WIDTH)
    one = F.element_at(words, -1)
    far = F.when((F.size(words) > 1) & F.col("m.apart") & whole & (F.get(words, F.size(words) - 2) != ""), F.get(words, F.size(words) - 2))
    near = F.when((F.size(after) > 2) & (F.get(after, 1) != ""), F.get(after, 1))
    forms = [one, F.concat(F.lit("2 "), far, F.lit(" "), one), F.concat(F.lit("R "), near)]
    forms += [F.concat(F.lit(mark), _class(x)) for mark, x in (("L ", one), ("W ", far), ("P ", near))]
    return F.filter(F.array(*forms), lambda c: c.isNotNull() & (c != ""))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a digit string passes the check; every second digit from the right counts twice, less 9 above 9."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, k: F.when(k % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(places, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def occurrences(texts: DataFrame) -> DataFrame:
    """(uid, kind, seed, start, end, instance, contexts) from ``texts(uid, text)``."""
    t = F.col("text")
    digit = t.rlike("[0-9]")
    chain_like = t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")
    marked = F.when(chain_like, F.regexp_replace(F.regexp_replace(t, NOT_CHAIN.replace(r"[\x20-]", "-"), "\x01"), NOT_CHAIN, "\n"))
    wanted = texts.where("text <> ''").where(digit | F.contains(t, F.lit("@")) | t.rlike(r"[\[(][aA][tT][\])]") | F.contains(t, F.lit("::")))
    kinds = F.array(
        _found("email", True, t, EMAIL, F.contains(t, F.lit("@"))),
        _found("ip", True, t, IP, t.rlike(r"[0-9]\.[0-9]")),
        _found("card", True, F.col("marked"), CHAIN, F.col("marked").isNotNull()),
        _found("phone", True, t, PHONE, F.contains(t, F.lit("+"))),
        _found("email", False, t, LOOSE_EMAIL, F.contains(t, F.lit("@")) | t.rlike(r"[\[(][aA][tT][\])]")),
        _found("ip", False, t, LOOSE_IP, t.rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f:]")),
        _found("phone", False, t, LOOSE_PHONE, t.rlike(r"[0-9][0-9)][0-9\x20./-]")),
    )
    hits = wanted.withColumn("marked", marked).select("uid", F.explode(F.filter(kinds, lambda k: F.size(k["matches"]) > 0)).alias("f"))
    rows = hits.select("uid", "f.kind", "f.seed", F.posexplode(_surroundings(F.col("f.matches"), F.col("f.gaps"))).alias("k", "m"))
    before = Window.partitionBy("uid", "kind", "seed").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("m.gap") + F.length("m.match")).over(before).cast("long"))
    x = F.col("m.match")
    digits = _digits(x)
    byte = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
    seeds = (
        F.when(F.col("kind") == "email", F.lit(True))
        .when(F.col("kind") == "ip", x.rlike(rf"^{byte}(?:\.{byte}){{3}}$"))
        .when(F.col("kind") == "card", F.length(digits).between(16, 19) & _luhn(F.substring(digits, 1, 19)))
        .otherwise(F.length(digits).between(8, 15))
    )
    # of failing matches only a chain as long as a card number stays, as a candidate
    loose = ~F.col("seed") & ((F.col("kind") != "phone") | F.length(digits).between(*LOOSE_DIGITS))
    rows = rows.withColumn("ok", seeds).where(loose | F.col("seed") & (F.col("ok") | (F.col("kind") == "card") & F.length(digits).between(12, 19))).withColumn("seed", F.col("seed") & F.col("ok"))
    return rows.select(
        "uid",
        "kind",
        "seed",
        (F.col("end") - F.length(x)).alias("start"),
        "end",
        F.when(F.col("kind").isin("card", "phone"), digits).otherwise(F.lower(x)).alias("instance"),
        _contexts().alias("contexts"),
    )


def _words(texts: DataFrame) -> DataFrame:
    return texts.select(F.filter(F.split(F.lower("text"), r"[\x09-\x0D\x20]+"), lambda w: w != "").alias("ws"))


def _totals(texts: DataFrame, rich: DataFrame) -> DataFrame:
    """(context, total): every occurrence in the corpus of each context of ``rich(context)``.

    Words are counted before anything is made of them: contexts of one word are forms of the distinct words. A label is a
    whole word, or a word's part before an identifier; both count wherever they stand.
    """
    wanted = rich.select("context").distinct()
    distinct = _words(texts).select(F.explode("ws").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    parts = F.split("w", GLUED)
    upto = lambda k: F.right(F.array_join(F.slice(parts, F.greatest(F.lit(1), k - WIDTH + 1), F.least(k, F.lit(WIDTH))), ""), F.lit(WIDTH))
    cut = F.when(F.col("w").rlike(GLUED), F.transform(F.sequence(F.lit(1), F.size(parts)), upto)).otherwise(F.array(F.right("w", F.lit(WIDTH))))
    classes = F.array_distinct(F.filter(F.transform("cut", _class), lambda c: c.isNotNull()))
    marked = lambda mark: F.transform("classes", lambda c: F.concat(F.lit(mark), c))
    forms = distinct.withColumn("cut", cut).withColumn("classes", classes)
    forms = forms.select("n", F.explode(F.concat("cut", F.array(F.concat(F.lit("R "), F.col("w"))), marked("L "), marked("W "), marked("P "))).alias("context"))
    totals = forms.join(wanted, "context").groupBy("context").agg(F.sum("n").alias("total"))
    pairs = wanted.where(F.col("context").startswith("2 "))
    if pairs.isEmpty():
        return totals
    # pairs are held against the wanted ones by their second words first; of these few are left to be shuffled
    seconds = pairs.select(F.element_at(F.split("context", " "), -1).alias("w")).distinct()
    both = _words(texts).select(F.explode(F.transform("ws", lambda w, k: F.struct(w.alias("w"), F.get(F.col("ws"), k - 1).alias("p")))).alias("x")).select("x.w", "x.p")
    both = both.join(seconds, "w").select(F.concat(F.lit("2 "), F.col("p"), F.lit(" "), F.col("w")).alias("context")).where("context IS NOT NULL")
    return totals.unionByName(both.groupBy("context").agg(F.count("*").alias("total")).join(pairs, "context"))


def _free(found: DataFrame) -> DataFrame:
    """Seeds, and the candidates that overlap none of their document's seeds: running ends before, running starts behind."""
    by_start = Window.partitionBy("uid").orderBy("start", "end", "kind", "seed")
    ended = F.max(F.when(F.col("seed"), F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    begun = F.min(F.when(F.col("seed"), F.col("start"))).over(by_start.rowsBetween(1, Window.unboundedFollowing))
    marked = found.withColumns({"_ended": ended, "_begun": begun})
    clear = (F.coalesce("_ended", F.lit(-1)) <= F.col("start")) & (F.col("_begun").isNull() | (F.col("_begun") >= F.col("end")))
    return marked.where(F.col("seed") | clear).drop("_ended", "_begun")


def learned(texts: DataFrame, found: DataFrame, support: int = SUPPORT, trust: float = TRUST, rounds: int = ROUNDS) -> DataFrame:
    """(uid, kind, start, end): candidates in trusted contexts, none overlapping a seed of the document."""
    found = keep(_free(found), "pii-free")
    none = found.select("uid", "kind", "start", "end").limit(0)
    placed = found.select("kind", "seed", "instance", F.explode("contexts").alias("context"))
    # inner joins on distinct keys, as the optimiser would move semi-joins below the counts;
    # only contexts of a candidate can report anything, and only they need corpus counts
    open_ = placed.where("NOT seed").select("kind", "context").distinct()
    seen = placed.groupBy("kind", "context", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed")).join(open_, ["kind", "context"])
    rich = seen.groupBy("kind", "context").agg(F.count("*").alias("kinds"), F.sum(F.col("seed").cast("int")).alias("seeds")).where(F.col("kinds") >= support)
    rich = keep(rich, "pii-rich")
    if rich.where(F.col("seeds") >= support).isEmpty():
        return none
    graph = keep(seen.join(rich.select("kind", "context"), ["kind", "context"]).join(_totals(texts, rich), "context"), "pii-graph")
    belief = graph.groupBy("kind", "instance").agg(F.max("seed").cast("double").alias("belief"))
    trusted, total_score, settled, tables = 0, 0.0, 0, []
    for _ in range(rounds):
        edges = graph.join(belief, ["kind", "instance"])
        scores = edges.groupBy("kind", "context").agg(
            (F.sum(F.col("n") * F.col("belief")) / F.max("total")).alias("raw"), F.sum((F.col("belief") > 0).cast("int")).alias("known")
        ).select("kind", "context", F.when(F.col("known") >= support, F.least("raw", F.lit(1.0))).otherwise(0.0).alias("score"))
        scores = keep(scores, "pii-scores")
        tables.append(scores)
        now = scores.where(F.col("score") >= trust).agg(F.count("*"), F.coalesce(F.sum("score"), F.lit(0.0))).first()
        settled = settled + 1 if now[0] == trusted and now[1] <= total_score * 1.01 else 0
        trusted, total_score = now
        if settled == 2 or not trusted:
            break
        best = lambda side: F.coalesce(F.max(F.when(side & (F.col("score") >= trust), F.col("score"))), F.lit(0.0))
        after = F.col("context").startswith("R ") | F.col("context").startswith("P ")
        both = 1 - (1 - best(~after)) * (1 - best(after))
        belief = keep(graph.join(scores, ["kind", "context"]).groupBy("kind", "instance").agg(F.when(F.max("seed"), 1.0).otherwise(both).alias("belief")), "pii-belief")
        tables.append(belief)
    else:
        raise RuntimeError(f"contexts still changed after {rounds} turns")
    forget(rich, graph, *tables[:-1])
    good = scores.where(F.col("score") >= trust).select("kind", "context")
    slots = found.where("NOT seed").select("uid", "kind", "start", "end", F.explode("contexts").alias("context"))
    return slots.join(good, ["kind", "context"]).select("uid", "kind", "start", "end").distinct()


def spans(texts: DataFrame, **options) -> DataFrame:
    """(uid, kind, start, end, seed) for ``texts(uid, text)``; uid must be unique and fixed."""
    found = keep(occurrences(texts), "pii-found")
    seeds = found.where("seed").select("uid", "kind", "start", "end", F.lit(True).alias("seed"))
    return seeds.unionByName(learned(texts, found, **options).withColumn("seed", F.lit(False)))


def _joined(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["k"]), s["start"], s["end"])), ",")


def personal_data(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row of ``docs``.

    Counts and the digest cover the seeds; spans also hold what was learned. Null and empty texts have no spans. Repeated
    rows are reported each. An empty table gives an empty result. Spans are gathered for one document at a time.
    """
    texts = numbered(docs, ["doc_id", "text"], "pii-docs").select(F.col("_row").alias("uid"), "doc_id", "text")
    cell = F.struct(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int").alias("k"), "start", "end", "seed")
    per_doc = spans(texts.select("uid", "text"), **options).groupBy("uid").agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    out = texts.select("uid", "doc_id").join(per_doc, "uid", "left").withColumn("cells", F.coalesce("cells", F.array().cast(per_doc.schema["cells"].dataType)))
    base = F.filter("cells", lambda s: s["seed"])
    count = lambda n: F.size(F.filter(base, lambda s: s["k"] == n)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS, 1)]
    return out.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("cells")).alias("spans"))


def redacted(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each span of personal data in the text replaced by its kind in brackets; ``n_chars`` follows the text."""
    used = [c for c in ("text", "n_chars") if c in docs.columns]
    all_ = numbered(docs, used, "pii-docs").withColumnRenamed("_row", "uid")
    merged = spans(all_.select("uid", "text"), **options).groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("cells"))
    # where spans overlap, the text is cut at the furthest end so far
    step = lambda a, s: F.struct(
        F.concat(
            a["text"],
            F.when(s["start"] >= a["at"], F.concat(F.substring(F.col("text"), a["at"] + 1, s["start"].cast("int") - a["at"]), F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit("")),
        ).alias("text"),
        F.greatest(a["at"], s["end"].cast("int")).alias("at"),
    )
    new = F.aggregate("cells", F.struct(F.lit("").alias("text"), F.lit(0).alias("at")), step)
    out = all_.join(merged, "uid", "left").withColumn("_new", F.when(F.col("cells").isNotNull(), new))
    text = F.when(F.col("_new").isNotNull(), F.concat(F.col("_new.text"), F.expr("substring(text, _new.at + 1)"))).otherwise(F.col("text"))
    out = out.withColumn("text", text)
    if "n_chars" in used:
        out = out.withColumn("n_chars", F.when(F.col("_new").isNotNull(), F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return unpacked(out, docs.columns, used)
