"""Text and name operators against plain readings of the same rules on small inputs."""
import random
import re


from graftline import fixed_values as fx
from graftline.functions.names import name_key, name_key_full
from graftline.operators import corpus as co
from graftline.operators import matching as mt


def test_tags_from_text(spark):
    words = ["vanilla", "honey", "no", "not", "floral", "rose-water", "spicy", "lacking", "pear", "pearmain", "pear-drop", ";", ".", "a", "fine", "sweet", "unlike", "nothing", "Nutty", "tea", "earthy", "with", "little", "banana"]
    rng = random.Random(3)
    texts = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(200)]
    neg = re.compile(fx.NEGATION + r"[^.;]{0,25}$")

    def plain(t):
        out = []
        for tag, rx in fx.TAG_PATTERNS.items():
            if any(not neg.search(t[max(0, m.start() - 40):m.start()]) for m in re.finditer(rx, t, re.I)):
                out.append(tag)
        return out[:8]

    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "variety_id int, text string, tags array<string>")
    got = {}
    for r in co.scan_tags(df).orderBy("variety_id", "pos").collect():
        got.setdefault(r["variety_id"], []).append(r["tag"])
    assert all(got.get(i, []) == plain(t) for i, t in enumerate(texts))


def test_page_numbers_in_chunks(spark):
    rng = random.Random(5)
    lines, want = [], {}
    for book in ("a", "b", "c", "d"):
        last, page = 0, None
        for i in range(1, 400):
            n = max(0, i // 3 + rng.randint(-3, 60)) if i % 2 and not 120 < i < 260 else None
            n = 900 if book == "c" and n is not None else 0 if book == "d" and i == 5 else n if book != "d" or i > 20 else None
            lines.append((book, i, f" {n} " if n is not None else "prose 12"))
            if n is not None and (last < n <= last + 40 or last == 0 and n <= 40):
                page = last = n
            want[(book, i)] = page
    df = spark.createDataFrame(lines, "book string, line_no long, text string")
    got = {(r["book"], r["line_no"]): r["page"] for r in co.page_numbers(df, chunk_lines=50).collect()}
    assert got == want and want["c", 399] is None and want["d", 6] == 0


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (x != y))
    return d[-1]


def test_within_edits(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 22)))
    left = sorted({word() for _ in range(150)})
    right = set(left[:40])
    for w in left:                                                              # near copies: up to three changes
        x = list(w)
        for _ in range(rng.randint(1, 4)):
            i = rng.randrange(len(x) + 1)
            op = rng.random()
            if op < 0.4 and x:
                x[i % len(x)] = rng.choice("abcd")
            elif op < 0.7:
                x.insert(i, rng.choice("abcd"))
            elif len(x) > 1:
                x.pop(i % len(x))
        right.add("".join(x))
    right = sorted(right)
    want = {(a, b, edits(a, b)) for a in left for b in right if edits(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9)}
    got = mt.within_edits(spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string"), "a", "b")
    assert {tuple(r) for r in got.collect()} == want and len(want) > 60


def test_close_pairs(spark):
    """Every pair with the ratio, and no other, in either order of the texts; short alphabets make many blocks."""
    from difflib import SequenceMatcher

    from graftline.operators.closeness import close_pairs

    rng = random.Random(17)
    left, right = set(), set()
    for letters, n in (("ab", 60), ("abcdef", 80), ("abcdefghijklmnopqrstuvwxyz é", 80)):
        for _ in range(n):
            w = [rng.choice(letters) for _ in range(rng.randint(1, 24))]
            left.add("".join(w))
            for _ in range(2):
                x = list(w)
                for _ in range(rng.randint(0, max(1, len(w) // 4))):
                    i = rng.randrange(len(x) + 1)
                    x[i:i + rng.randint(0, 1)] = [rng.choice(letters)] if rng.random() < 0.6 else []
                right.add("".join(x))
    left |= {"a" * 250, "ab" * 120}  # longer than 200 letters common ones do not count
    right |= {"a" * 249, "ab" * 119, ""}
    a, b = spark.createDataFrame([(x,) for x in left] + [(None,)], "x string"), spark.createDataFrame([(x,) for x in right], "y string")
    for ratio, apart in ((0.8, None), (0.9, None), (0.8, 1)):
        want = {(x, y) for x in left for y in right if SequenceMatcher(None, x, y).ratio() >= ratio and (apart is None or abs(len(x) - len(y)) <= apart)}
        got = close_pairs(a, b, "x", "y", ratio, apart).collect()
        assert {(r["x"], r["y"]) for r in got} == want and len(got) == len(want) > 50
        assert all(r["ratio"] == SequenceMatcher(None, r["x"], r["y"]).ratio() for r in got)


def test_name_keys(spark):
    names = ["Cox’s Orange Pippin", "St. Edmund's Russet", "Saint Cecilia", "Königin  Sophien", "D&#39;Arcy Spice", "Belle de Boskoop™", "Crème brûlée", "ﬁne old", "Peck & Co", "Ångström"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(name_key("n").alias("a"), name_key_full("n").alias("b")).collect()
    assert all(r["a"] == r["b"] for r in df)
    assert [r["a"] for r in df][:3] == ["coxs orange pippin", "st edmunds russet", "st cecilia"]


def test_entry_text_cut(spark):
    lines = spark.createDataFrame([("b", 1, "HEAD. A green-"), ("b", 2, "ish fruit"), ("b", 3, " 12 "), ("b", 4, "more"), ("b", 5, ""), ("b", 6, "word " * 1200)], "book string, line_no long, text string")
    e = spark.createDataFrame([(1, "b", 1, 6)], "entry_id int, book string, line int, end int")
    t = co.entry_text(e, lines).collect()[0]["text"]
    assert t.startswith("HEAD. A greenish fruit more\n\nword word") and t.endswith("word …") and len(t) <= 5002


def test_tags_by_places(spark):
    """Places do not lie within one another, are judged by the text before them alone, and words end at any letter beyond ASCII."""
    texts = {1: "without any of the 21 letters raspberries", 2: "novanilla", 3: "purépear", 4: "no honey; honey", 5: "not a trace of vanilla, honey and some more vanilla"}
    df = spark.createDataFrame([(k, t, None) for k, t in texts.items()], "variety_id int, text string, tags array<string>")
    assert {(r["variety_id"], r["tag"]) for r in co.scan_tags(df).collect()} == {(3, "pear"), (4, "honey"), (5, "vanilla")}


def test_headings_of_many_varieties(spark, monkeypatch):
    """Keys within one another, of many varieties and in many books; nothing is moved once books and varieties have met."""
    monkeypatch.setattr(co, "VARIETIES_AT_ONCE", 3, raising=False)
    monkeypatch.setattr(co, "BOOKS_AT_ONCE", 4, raising=False)
    rng = random.Random(9)
    some = ["COX ORANGE", "COX ORANGE PIPPIN", "RED STREAK", "RED STREAK PIPPIN", "GOLDENBALL", "OLD RED STREAK"]
    varieties = {v: set(rng.sample(some, rng.randint(1, 4))) for v in range(40)}
    lines = []
    for book in range(12):
        for n in range(1, rng.randint(2, 40)):
            key = rng.choice([*some, "NOTHING HERE"])
            lines.append((f"b{book}", n, f" {rng.choice([key, key.title(), key.lower()])}{rng.choice(['', '.', ' and more', ', x'])}"))
    want = {}
    for book, n, text in lines:
        raw = text.strip()
        upper = " ".join(re.findall("[A-Z0-9]+", raw.upper()))
        for v, keys in varieties.items():
            for key in keys:
                if upper == key or upper.startswith(key + " "):
                    head = [c for c in raw[:len(key) + 6] if c.isalpha()]
                    after = raw[len(key):len(key) + 8] if len(raw) > len(key) else "."
                    score = round(1 + 2 * (sum(c.isupper() for c in head) / max(1, len(head)) > 0.8) + 0.5 * bool(re.match("[^a-z]*[.,—:;-]", after)) + 0.3 * (" " in key), 2)
                    want.setdefault((book, v), {}).setdefault(n, []).append((score, key, raw))
    want = {(b, v, n, s, key, raw, i) for (b, v), at in want.items() for i, (n, (s, key, raw)) in enumerate(sorted(((n, max(x)) for n, x in at.items()), key=lambda x: (-x[1][0], x[0]))[:6], 1)}
    df = co.locate(spark.createDataFrame(lines, "book string, line_no long, text string"), spark.createDataFrame([(v, key) for v, keys in varieties.items() for key in keys], "variety_id int, key string"))
    assert {(r["book"], r["variety_id"], r["line_no"], r["score"], r["key"], r["text"], r["rank"]) for r in df.collect()} == want and len(want) > 1000 and df.count() == len(want)
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "varieties" in plan.split("Exchange")[0] and "Window" not in plan.split("Exchange")[0]


def test_tags_are_tried_where_their_letters_are(spark):
    """Letters that patterns begin with are looked for first, in any case; patterns without such letters are tried everywhere."""
    texts = {1: "x" * 80 + " VANİLLA muſK", 2: "prose, a rose, rose-like; " + "é" * 90 + " Not a pear but pears. No pearmain", 3: "steady minute teas tea", 4: "not rosewater" + " " * 90 + "no nuts. Nut", 5: "12 zz", 6: "﷐honey ﷐ pear-drop"}
    df = spark.createDataFrame([(k, t, None) for k, t in texts.items()], "variety_id int, text string, tags array<string>")
    tags = co.scan_tags(df)
    assert {(r["variety_id"], r["tag"]) for r in tags.collect()} == {(1, "vanilla"), (1, "musky"), (2, "rose"), (2, "pear"), (3, "tea"), (4, "nutty"), (6, "honey"), (6, "pear-drop")}
    other = {"digits": r"\d+|none", "class": "[ab]c|steady", "group": "(?:z|y){2}", "late": "a[(|]b|é{3}"}
    assert {(r["variety_id"], r["tag"]) for r in co.scan_tags(df, other).collect()} == {(5, "digits"), (3, "class"), (5, "group"), (2, "late")}
    plan = tags._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE(text" not in plan and plan.count("lower(") == 1
