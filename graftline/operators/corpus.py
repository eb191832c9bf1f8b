"""Text corpus jobs over numbered lines: headings, page numbers, entry texts, quotation checks, tag scans.

`lines` has one row per (book, line_no, text); line numbers start at 1."""
from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from graftline import fixed_values as fx
from graftline.functions.names import heading_keys, name_key, upper_key, words
from graftline.operators.closeness import close_in_groups
from graftline.plans.lineage import cut

MAX_PAGE = 9999
PAGE_STEP = 40


def variety_headings(varieties: DataFrame) -> DataFrame:
    """(variety_id, key): the printed headings a variety may have."""
    return varieties.select("variety_id", F.explode(heading_keys("name", "aka")).alias("key"))


def _opening(text: str, n: Column) -> Column:
    """The start of a line as far as its n-th token with a plain letter or digit.

    Every such token makes at least one word of a key and no word crosses a space, so the first n words are in it."""

    def leading(tokens: Column) -> Column:
        counted = F.filter(F.transform(tokens, lambda t, i: F.when(t.rlike("[A-Za-z0-9]"), i + 1)), lambda i: i.isNotNull())
        return F.array_join(F.slice(tokens, 1, F.coalesce(F.try_element_at(counted, n), F.size(tokens))), " ")

    return F.element_at(F.transform(F.array(F.split(text, r"\s+")), leading), 1)


#: So many varieties of one heading and so many books with it are paired by one task at most.
VARIETIES_AT_ONCE, BOOKS_AT_ONCE = 4096, 1024


def _heading_classes(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(variety_id, class) and (class, key): varieties with the same headings have the same candidates and make one class."""
    sets = keys.groupBy("variety_id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    classes = cut(sets.select("keys").distinct().withColumn("class", F.monotonically_increasing_id()))
    return sets.join(classes, "keys").select("variety_id", "class"), classes.select("class", F.explode("keys").alias("key"))


#: Words of 64 places each that keys are marked in; the table is 2 MB however many keys there are.
KEY_WORDS = 1 << 18


def _marked(key: Column | str) -> tuple[Column, Column]:
    """The word a key is marked in, and its place there."""
    h = F.xxhash64(key)
    return F.pmod(F.shiftright(h, 6), F.lit(KEY_WORDS)).cast("int"), F.pmod(h, F.lit(64)).cast("int")


def _key_marks(keys: DataFrame) -> Column:
    """All keys as marks in one array, so that most openings that are no key are left out where the lines lie."""
    word, place = _marked("key")
    marks = keys.select(word.alias("word"), place.alias("place")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("marks"))
    every = keys.sparkSession.range(KEY_WORDS).select(F.col("id").cast("int").alias("word")).join(marks, "word", "left").select("word", F.coalesce("marks", F.lit(0)).alias("marks"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "marks"))), lambda x: x["marks"])).scalar()


def _ways(found: DataFrame, live: DataFrame) -> DataFrame:
    """(book, key, at): the other keys found in the book that some class has beside a key.

    Two keys of a class are looked for in the books of the one that fewer books have."""
    a, b = live.select("class", F.col("key").alias("a"), F.col("books").alias("m")), live.select("class", F.col("key").alias("b"), F.col("books").alias("n"))
    beside = a.join(b, "class").where("m < n OR m = n AND a < b").select("a", "b").distinct()
    both = found.withColumnRenamed("key", "a").join(beside, "a").join(found.withColumnRenamed("key", "b"), ["book", "b"])
    return both.select("book", F.explode(F.array(F.struct(F.col("a").alias("key"), F.col("b").alias("at")), F.struct(F.col("b").alias("key"), F.col("a").alias("at")))).alias("w")).select("book", "w.*")


def _best_lines(others: Column, k: int) -> Column:
    """The best lines of a class that has `key` and `others`; null if one of its keys that comes before `key` stands in the book as well."""

    def of_several(cand: Column) -> Column:
        better = lambda x, y: (y["line_no"] == x["line_no"]) & ((y["worse"] < x["worse"]) | ((y["worse"] == x["worse"]) & (y["key"] > x["key"])))
        return F.slice(F.array_sort(F.filter(cand, lambda x: ~F.exists(cand, lambda y: better(x, y)))), 1, k)

    def chosen(mine: Column) -> Column:
        several = F.when(~F.exists(mine, lambda x: x["key"] < F.col("key")), F.element_at(F.transform(F.array(F.concat(F.col("lines"), mine)), of_several), 1))
        return F.when(F.size(mine) == 0, F.col("lines")).otherwise(several)

    mine = F.filter("beside", lambda x: F.array_contains(others, x["key"]))
    return F.when(F.size("beside") == 0, F.col("lines")).otherwise(F.element_at(F.transform(F.array(mine), chosen), 1))


def locate(lines: DataFrame, keys: DataFrame, k: int = 6, chunk_lines: int = 500_000) -> DataFrame:
    """Candidate headings: lines that open with a key, scored for capitals, punctuation and length; best six per book and variety,
    with the page they stand on.

    A line offers each of its openings (as many words as the longest key has), and those that are a key stay, with the beginning of
    their line.  A line among the best six of a variety is among the best six with its own key, so no more lines of a book and key are
    kept, in one row, together with those of other keys found in the book that a class has as well; where a book has several keys of a
    class, their lines are merged at the first of these keys.  Rows for every book and variety are made last, out of a row for the book
    and key and a list of varieties with the key, and are not moved, sorted or written after; of what is moved, only the lists of a
    heading in very many books and the rows of one with very many varieties are repeated, once for some thousand pairs."""
    keys = cut(keys)
    longest = keys.agg(F.max(F.size(F.split("key", " ")))).scalar()
    # no more of a line is looked at, or shown, than its beginning
    seen = F.greatest(F.lit(160), keys.agg(F.max(F.length("key"))).scalar() + 9)
    raw = F.trim("text")
    sized = lines.where(F.length(raw) >= 5).select("book", "line_no", raw.alias("raw"), longest.alias("longest"))

    def openings(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.least(F.size(w), F.col("longest"))), lambda n: F.array_join(F.slice(w, 1, n), " "))

    opened = sized.select("book", "line_no", F.col("raw").substr(F.lit(1), seen.cast("int")).alias("raw"), F.explode_outer(F.element_at(F.transform(F.array(F.split(upper_key(_opening("raw", F.col("longest"))), " ")), openings), 1)).alias("key"))
    word, place = _marked("key")
    hits = opened.where(F.bit_get(F.element_at(_key_marks(keys), word + 1), place) == 1).join(keys.select("key").distinct(), "key", "left_semi")
    size = F.length("key")
    head = F.col("raw").substr(F.lit(1), size + 6)
    letters, capitals = F.length(F.regexp_replace(head, r"[^\p{L}]", "")), F.length(F.regexp_replace(head, r"[^\p{Lu}]", ""))
    after = F.when(F.length("raw") > size, F.col("raw").substr(size + 1, F.lit(8))).otherwise(".")
    score = (F.lit(1.0) + F.when(capitals / F.greatest(F.lit(1), letters) > 0.8, 2.0).otherwise(0.0) + F.when(after.rlike(r"^[^a-z]*[.,—:;-]"), 0.5).otherwise(0.0)
             + F.when(F.contains("key", F.lit(" ")), 0.3).otherwise(0.0))
    scored = hits.withColumn("score", F.round(score, 2)).groupBy("book", "key", "line_no").agg(F.max("score").alias("score"), F.first(F.substring("raw", 1, 160)).alias("text"))
    of_key = Window.partitionBy("book", "key").orderBy(F.desc("score"), "line_no")
    first = scored.withColumn("rank", F.row_number().over(of_key)).where(F.col("rank") <= k).drop("rank")
    paged = first.join(page_numbers(lines, chunk_lines), ["book", "line_no"], "left").groupBy("book", "line_no", "key").agg(*[F.first(c).alias(c) for c in ("score", "page", "text")])
    top = cut(paged.select("book", "key", F.struct((-F.col("score")).alias("worse"), "line_no", "key", "page", "text").alias("line")))

    found = top.select("book", "key").distinct()
    members, class_keys = _heading_classes(keys)
    live = cut(class_keys.join(found.groupBy("key").agg(F.count("*").alias("books")), "key"))
    held = live.join(members, "class")
    # a heading of many varieties is dealt in shares and its books in parts; each share meets each part
    sizes = cut(held.groupBy("key").agg(F.ceil(F.count("*") / VARIETIES_AT_ONCE).cast("int").alias("shares"), F.ceil(F.first("books") / BOOKS_AT_ONCE).cast("int").alias("parts")))
    lists = held.join(sizes, "key").withColumn("share", F.pmod(F.xxhash64("variety_id"), F.col("shares")).cast("int")).groupBy("class", "key", "share", "parts").agg(F.collect_list(F.struct("variety_id")).alias("varieties"))
    lists = lists.join(live.groupBy("class").agg(F.collect_set("key").alias("all")), "class").groupBy("key", "share", "parts").agg(F.collect_list(F.struct(F.array_remove("all", F.col("key")).alias("others"), "varieties")).alias("classes"))
    dealt = lists.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    at = F.explode(F.concat(F.array("key"), F.coalesce("ats", F.array().cast("array<string>"))))
    spread = top.join(_ways(found, live).groupBy("book", "key").agg(F.collect_set("at").alias("ats")), ["book", "key"], "left").select("book", at.alias("key"), "line")
    tops = spread.groupBy("book", "key").agg(F.collect_list("line").alias("all")).select("book", "key", F.array_sort(F.filter("all", lambda x: x["key"] == F.col("key"))).alias("lines"), F.filter("all", lambda x: x["key"] != F.col("key")).alias("beside"))
    placed = tops.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("book"), F.col("parts")).cast("int"))
    offered = placed.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares", "parts")
    pairs = offered.join(dealt, ["key", "share", "part"]).select("book", "key", "lines", "beside", F.explode("classes").alias("c"))
    best = pairs.select("book", F.col("c.varieties").alias("varieties"), _best_lines(F.col("c.others"), k).alias("best"))
    rows = best.select("book", "varieties", F.posexplode("best").alias("at", "x")).select("book", "at", "x", F.explode("varieties").alias("v"))
    return rows.select("book", "v.variety_id", "x.line_no", "x.page", (-F.col("x.worse")).alias("score"), "x.key", "x.text", (F.col("at") + 1).alias("rank"))


def _page_rule(numbers: list[int]) -> tuple[list[int], list[int]]:
    """Where a run of number lines leads from every page it could start on, as break points: (from page, page at the end or -1 for
    "stays").  Pages that lead to the same place are one group from there on, so a number costs at most PAGE_STEP looks."""
    group = {}  # current page -> the start pages that are there now; a page not listed is still only its own
    moved: set[int] = set()  # pages nobody is on any more
    for n in numbers:
        here = [p for p in range(max(0, n - PAGE_STEP), n) if p not in moved]
        if here:
            joined = [s for p in here for s in group.pop(p, [p])] + (group.pop(n, [n]) if n not in moved else [])
            group[n] = joined
            moved.update(here)
            moved.discard(n)
    end = {s: p for p, starts in group.items() for s in starts}
    begin, to = [0], [end.get(0, -1)]
    for s in sorted({x for s in end for x in (s, s + 1)} - {0}):
        if (e := end.get(s, -1)) != to[-1]:
            begin.append(s)
            to.append(e)
    return begin, to


def _dealt(numbers: DataFrame) -> DataFrame:
    """Number lines with each chunk whole and in order; a task streams over many chunks."""
    return numbers.repartition("book", "chunk").sortWithinPartitions("book", "chunk", "line_no")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(book, chunk, rows) of each chunk in turn; a chunk may go over the end of a batch."""
    rows = itertools.chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches)
    for (book, chunk), group in itertools.groupby(rows, key=lambda r: r[:2]):
        yield book, chunk, list(group)


def _lots(chunks: Iterator[tuple], size: int = 1_000) -> Iterator[list[tuple]]:
    while some := list(itertools.islice(chunks, size)):
        yield some


def page_numbers(lines: DataFrame, chunk_lines: int = 500_000) -> DataFrame:
    """(book, line_no, page) of every line: the last standalone number accepted so far, null before the first.

    A number is accepted if it is above the last page by at most 40 (a 0 only at the start).  The rule needs the page before, so a book
    is read in chunks: each works out where it leads from every page it could start on, as a short table of break points; the tables of
    a book are applied in order; then each chunk runs again from its true start.  No task sees more than the lines of one chunk."""
    n = F.trim("text")
    all_lines = lines.select("book", "line_no", F.floor(F.col("line_no") / chunk_lines).cast("long").alias("chunk"), F.when(n.rlike(r"^\d{1,4}$"), n.cast("int")).alias("n"))
    numbers = all_lines.where("n IS NOT NULL")
    kind = numbers.schema["book"].dataType.simpleString()
    book_type = to_arrow_type(numbers.schema["book"].dataType)

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _lots(_chunks(batches)):
            rules = [_page_rule([r[3] for r in rows]) for _, _, rows in some]
            yield pa.RecordBatch.from_pydict({"book": pa.array([b for b, _, _ in some], book_type), "chunk": [c for _, c, _ in some], "begin": pa.array([r[0] for r in rules], pa.list_(pa.int32())), "to": pa.array([r[1] for r in rules], pa.list_(pa.int32()))})

    tables = _dealt(numbers.select("book", "chunk", "line_no", "n")).mapInArrow(transfer, f"book {kind}, chunk long, begin array<int>, to array<int>")
    ordered = tables.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("chunk", "begin", "to"))).alias("ts"))

    def step(page: Column, t: Column) -> Column:
        to = F.element_at(t["to"], F.size(F.filter(t["begin"], lambda b: b <= page)))
        return F.when(to < 0, page).otherwise(to)

    ends = F.aggregate("ts", F.array(F.lit(0)), lambda a, t: F.concat(a, F.array(step(F.element_at(a, -1), t))))
    ways = (ordered.select("book", F.arrays_zip(F.transform("ts", lambda t: t["chunk"]).alias("chunk"), F.slice(ends, 1, F.size("ts")).alias("start"), F.slice(ends, 2, F.size("ts")).alias("end")).alias("z"))
            .select("book", F.explode("z").alias("z")).select("book", "z.chunk", "z.start", "z.end"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _lots(_chunks(batches)):
            out = []
            for book, _, rows in some:
                last = rows[0][4]
                for _, _, line_no, value, _ in rows:
                    last = value if last < value <= last + PAGE_STEP else last
                    out.append((book, line_no, last))
            yield pa.RecordBatch.from_pydict({"book": pa.array([r[0] for r in out], book_type), "line_no": pa.array([r[1] for r in out], pa.int64()), "last": pa.array([r[2] for r in out], pa.int32())})

    reached = _dealt(numbers.join(ways, ["book", "chunk"]).select("book", "chunk", F.col("line_no").cast("long").alias("line_no"), "n", "start")).mapInArrow(run, f"book {kind}, line_no long, last int")
    by_chunk = Window.partitionBy("book").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = all_lines.select("book", "chunk").distinct().join(ways, ["book", "chunk"], "left").select("book", "chunk", F.coalesce(F.last("end", True).over(by_chunk), F.lit(0)).alias("carried"))
    zero = numbers.where("n = 0").groupBy("book").agg(F.min("line_no").alias("zero"))
    so_far = Window.partitionBy("book", "chunk").orderBy("line_no")
    page = F.coalesce(F.last("last", True).over(so_far), F.col("carried"))
    known = all_lines.join(reached, ["book", "line_no"], "left").join(carried, ["book", "chunk"]).join(zero, "book", "left").withColumn("page", page)
    return known.select("book", "line_no", F.when(F.col("page") > 0, F.col("page")).when(F.col("line_no") >= F.col("zero"), 0).alias("page"))


def _entry_lines(entries: DataFrame, lines: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """The lines of each entry, joined on the line number."""
    e = entries.select("entry_id", "book", F.explode(F.sequence(F.greatest(F.lit(1), F.col("line") - before), F.col("end") + after)).alias("line_no"))
    return e.join(lines, ["book", "line_no"])


def entry_text(entries: DataFrame, lines: DataFrame, limit: int = 5000) -> DataFrame:
    """Readable paragraphs of an entry: page numbers dropped, hyphenated line ends joined, spaces collapsed; what is shown is cut
    at a word after 5000 characters."""
    j = _entry_lines(entries, lines).withColumn("s", F.regexp_replace(F.trim(F.regexp_replace("text", r"\s+", " ")), "�", "—"))
    g = j.where(~F.col("s").rlike(r"^\d{1,4}$")).groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "s"))).alias("ls"))
    text = F.array_join(F.transform("ls", lambda x: x["s"]), "\n")
    paras = F.filter(F.split(text, r"\n(?:\n)+"), lambda p: F.trim(p) != "")
    joined = F.transform(paras, lambda p: F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"^\n+|\n+$", ""), r"-\n(?=\p{Ll})", ""), r"\n", " "))
    g = g.select("entry_id", F.array_join(joined, "\n\n").alias("full"))
    shown = F.concat(F.regexp_replace(F.substring("full", 1, limit), r"(?s) [^ ]*$", ""), F.lit(" …"))
    return g.select("entry_id", F.when(F.length("full") <= limit, F.col("full")).otherwise(shown).alias("text"))


def check_spans(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """Entries whose line span is wrong: outside the book, ending before it starts, or longer than 400 lines."""
    sizes = lines.groupBy("book").agg(F.max("line_no").alias("n_lines"))
    j = entries.join(sizes, "book", "left")
    ok = (F.col("line") >= 1) & (F.col("line") <= F.col("end")) & (F.col("end") <= F.col("n_lines"))
    problem = F.when(~F.coalesce(ok, F.lit(False)), "outside").when(F.col("end") - F.col("line") > 400, "too_long")
    return j.select("entry_id", "book", "line", "end", "n_lines", problem.alias("problem")).where("problem IS NOT NULL")


def verify_quotes(entries: DataFrame, quotes: DataFrame, lines: DataFrame, at_least: float = 0.8) -> DataFrame:
    """Share of each quote's words that the entry's own lines contain: verbatim, run together with a neighbour, or in a spelling with a
    sequence ratio of 0.8 and at most two letters more or less (words of four letters or more).  A quote needs 80%.

    `quotes`: entry_id, field, quote.  The lines are read two above and two below the entry.  The entry words and the words
    found directly are each read several times, so both are cut off at the shared folder."""
    chunk = (_entry_lines(entries, lines, before=2, after=2).groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("ls"))
             .select("entry_id", F.array_join(F.transform("ls", lambda x: x["text"]), "\n").alias("chunk")))
    # a word split by a hyphen counts both joined and as its two halves
    pool = cut(chunk.select("entry_id", F.explode(F.array_distinct(F.concat(words("chunk"), F.regexp_extract_all(F.lower("chunk"), F.lit("([a-z]+)"), 1)))).alias("p")))
    q = quotes.select("entry_id", "field", words("quote").alias("ws")).where(F.size("ws") > 0)
    at = lambda i: F.coalesce(F.try_element_at("ws", i), F.lit(""))             # noqa: E731
    q = q.select("entry_id", "field", "ws", F.posexplode("ws").alias("i", "x"))
    nxt, prv = at(F.col("i") + 2), F.when(F.col("i") > 0, at(F.greatest(F.lit(1), F.col("i")))).otherwise("")
    q = q.select("entry_id", "field", "i", "x", F.array(F.col("x"), F.when(nxt != "", F.concat("x", nxt)), F.when(prv != "", F.concat(prv, F.col("x")))).alias("forms"))
    forms = q.select("entry_id", "field", "i", "x", F.explode(F.array_compact("forms")).alias("p"))
    direct = cut(forms.join(pool.withColumn("hit", F.lit(1)), ["entry_id", "p"], "left").groupBy("entry_id", "field", "i", "x").agg(F.max("hit").alias("hit")))
    open_words = direct.where("hit IS NULL AND length(x) >= 4").select("entry_id", "x").distinct()
    near = close_in_groups(open_words, pool, "entry_id", "x", "p", 0.8, most_apart=2).select("entry_id", "x").distinct().withColumn("near", F.lit(1))
    found = direct.join(near, ["entry_id", "x"], "left").withColumn("found", F.coalesce("hit", "near", F.lit(0)))
    return found.groupBy("entry_id", "field").agg(F.count("*").alias("words"), F.avg("found").alias("share")).withColumn("ok", F.col("share") >= at_least)


#: Stands before each place of a pattern; a character that Unicode keeps for such use, which is no part of a word.
PLACE, NO_PLACE = "\ufdd0", "\ufdd1"
#: So many characters before a place decide whether it is negated.
BEFORE = 60


def _ascii_words(pattern: str) -> str:
    r"""The pattern with word bounds between ASCII letters, digits and underscores only; Java 17 counts every letter in \b.

    A bound before a letter is looked at only where that letter stands."""
    bound = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
    return re.sub(r"\\b([A-Za-z0-9])(?![?*{])", lambda m: f"(?={m[1]}){bound}{m[1]}", pattern).replace(r"\b", bound)


def _stems(pattern: str) -> list[str] | None:
    """The letters each alternative of a pattern begins with: whatever matches contains one of them.  None if one begins otherwise."""
    parts, depth = [""], 0
    for x in re.findall(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|.", pattern, re.S):
        depth += (x == "(") - (x == ")")
        if x == "|" and depth == 0:
            parts.append("")
        else:
            parts[-1] += x
    found = [re.match(r"(?:\\b)*((?:[A-Za-z0-9 -](?![?*{]))+)", x) for x in parts]
    stems = {m[1].lower() for m in found if m}
    return sorted(x for x in stems if not any(x != y and x.startswith(y) for y in stems)) if all(found) else None


#: Characters beyond ASCII that Unicode takes for letters of ASCII where case does not matter.
LIKE_ASCII = {"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"}


def _folded(text: Column | str) -> Column:
    """The text with one case, as many characters as before."""
    c = F.col(text) if isinstance(text, str) else text
    for k, v in LIKE_ASCII.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return F.lower(c)


def tag_found(text: Column | str, pattern: str) -> Column:
    """Whether a pattern occurs without a negation in the clause before it (at most 25 characters back).

    The places are found from left to right, none within another, and each is judged by the end of what stands before it."""
    c = F.col(text) if isinstance(text, str) else text
    rx, negated = _ascii_words(f"(?iu:{pattern})"), _ascii_words(fx.NEGATION) + r"[^.;]{0,25}\z"
    between = F.split(F.regexp_replace(F.replace(c, F.lit(PLACE), F.lit(NO_PLACE)), rx, f"{PLACE}$0"), PLACE)

    def place(seen: Column, more: Column) -> Column:
        before = F.right(F.concat(seen["before"], more), F.lit(BEFORE))
        return F.transform(F.array(before), lambda b: F.struct(b.alias("before"), (seen["found"] | ~b.rlike(negated)).alias("found")))[0]

    def judged(parts: Column) -> Column:
        return F.aggregate(F.slice(parts, 1, F.size(parts) - 1), start, place)["found"]

    start = F.struct(F.lit("").alias("before"), F.lit(False).alias("found"))
    return F.element_at(F.transform(F.array(between), judged), 1)


def scan_tags(texts: DataFrame, patterns: dict[str, str] = fx.TAG_PATTERNS, limit: int = fx.MAX_TAGS) -> DataFrame:
    """Tags a written summary names but the record lacks, as many as the record has room for (eight in all).

    A text is first searched for the letters that patterns begin with; a pattern is tried only where its letters occur, from as far
    before them as its places are judged by.

    `texts`: variety_id, text, tags."""
    t = texts.where("text IS NOT NULL AND text <> ''").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    t = t.withColumn("_folded", _folded("text"))

    def first(pattern: str) -> Column:
        stems = _stems(pattern)
        if stems is None:
            return F.lit(1)
        at = [F.when(F.contains("_folded", F.lit(x)), F.instr("_folded", x)) for x in stems]
        return F.least(*at) if len(at) > 1 else at[0]

    t = t.select("variety_id", "text", "tags", *[first(rx).alias(f"_at{i}") for i, rx in enumerate(patterns.values())])

    def found(i: int, rx: str) -> Column:
        at = F.col(f"_at{i}")
        return at.isNotNull() & tag_found(F.substr("text", F.greatest(F.lit(1), at - BEFORE - 1)), rx)

    named = F.array_compact(F.array(*[F.when(found(i, rx), F.lit(tag)) for i, (tag, rx) in enumerate(patterns.items())]))
    new = F.slice(F.array_except(named, "tags"), 1, F.greatest(F.lit(0), F.lit(limit) - F.size("tags")))
    return t.select("variety_id", F.posexplode(new).alias("pos", "tag"))


def book_headings(lines: DataFrame) -> DataFrame:
    """Distinct (book, heading): line openings of two to five words, and single words printed in capitals."""
    w = F.slice(F.split(name_key("text"), " "), 1, 5)
    openings = (lines.select("book", w.alias("w")).where(F.size("w") >= 2)
                .select("book", F.explode(F.transform(F.sequence(F.lit(2), F.size("w")), lambda n: F.array_join(F.slice("w", 1, n), " "))).alias("heading")))
    caps = F.regexp_extract(F.concat("text", F.lit("\n")), r"^\s*([A-Z][A-Z'’-]{4,})[.,\s]", 1)
    single = lines.select("book", caps.alias("c")).where("c <> ''").select("book", name_key("c").alias("heading"))
    return openings.unionByName(single).distinct()


def searchable(name: Column | str) -> Column:
    """Key of a name for looking it up in old books; null for names made of common words only."""
    k = name_key(name)
    common = F.forall(F.split(k, " "), lambda w: w.isin(*fx.COMMON_NAME_WORDS))
    return F.when((k != "") & ~common, k)
