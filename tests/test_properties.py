"""Column expressions against restatements in Python over random inputs."""

import random
import re
import statistics
from datetime import date
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from sheafline.functions import dates, numbers, text
from sheafline.operators import loops, ocr, postprocess


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").repartition(3)
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def strings(rng, letters, n=1500, most=14):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(most))) for _ in range(n)]


def amount(s):
    s = re.sub(r"^(VNĐ|VND|USD)\s*", "", re.sub("[đ₫]$", "", s.strip().replace(" ", "")), flags=re.I).strip()
    if re.fullmatch(r"\d+(-\d{3})+", s):
        s = s.replace("-", "")
    s = s.replace(",", ".") if re.fullmatch(r"[^,]*,\d{1,2}", s) else s.replace(",", "")
    if re.fullmatch(r"[^.]*(\.\d{3})+", s):
        s = s.replace(".", "")
    try:
        return float(s)
    except ValueError:
        return None


def test_amounts(spark):
    values = strings(random.Random(1), ["1", "2", "000", "345", ".", ",", "-", " ", "đ", "VND", "e", "_"], most=7)
    assert apply(spark, numbers.coerce_numeric, values) == [amount(v) for v in values]


def day(y, m, d):
    try:
        return date(y, m, d).isoformat()
    except ValueError:
        return None


def plain_date(s):
    s = s.strip()
    sep = r"[\s./\-]"
    for pattern, orders in ((rf"(\d{{4}}){sep}(\d{{1,2}}){sep}(\d{{1,2}})", ["abc"]), (rf"(\d{{1,2}}){sep}(\d{{1,2}}){sep}(\d{{4}})", ["cba", "cab"]), (r"(\d{4})(\d\d)(\d\d)", ["abc", "cba"])):
        if m := re.fullmatch(pattern, s):
            g = dict(zip("abc", map(int, m.groups())))
            return next((x for o in orders if (x := day(*(g[k] for k in o)))), s)
    if m := re.fullmatch(rf"(\d\d){sep}(\d{{1,2}}){sep}(\d{{1,2}})", s):
        a, b, c = map(int, m.groups())
        y, d = (2000 + c, a) if c > 31 >= a else (2000 + a, c)
        return day(y, b, d) or day(y, d, b) or s
    return s or None


def test_dates(spark):
    rng = random.Random(2)
    values = ["".join(str(rng.choice([rng.randrange(1, 13), rng.randrange(0, 60), f"{rng.randrange(99):02d}", rng.randrange(1900, 2100)])) + rng.choice(["-", "/", ".", " ", ""]) for _ in range(3)).rstrip("-/. ") for _ in range(1500)]
    assert apply(spark, dates.normalize_date, values) == [plain_date(v) for v in values]


def plain_loops(s):
    out = []
    for n in (2, 3, 4):
        for m in re.finditer(rf"(.{{{n}}})\1{{3,}}", s):
            if not m[1].isdigit() and not set(m[1]) <= set(text.STRUCTURE):
                out.append(m[1])
    return out


def test_ngram_loops(spark):
    rng = random.Random(3)
    values = ["".join(rng.choice(["ab", "12", "null,", "x", "yz1", "\n", "ab" * 4, "abc" * 4, "1a2b" * 4, "kkkk"]) for _ in range(rng.randrange(8))) for _ in range(800)]
    assert apply(spark, text.ngram_loops, values) == [plain_loops(v) for v in values]
    assert apply(spark, text.has_char_run, values) == [bool(re.search(r"([^\d\s])\1{5,}", v)) for v in values]


def test_similar_names(spark):
    rng = random.Random(4)
    pairs = [("king food market", "King"), ("mega market", "Mega"), ("bach hoa xanh", "BHX")]
    names = []
    for _ in range(200):
        n = list(rng.choice(pairs)[0])
        for _ in range(rng.randrange(4)):
            n[rng.randrange(len(n))] = rng.choice("abcdexyz ")
        names.append("".join(n))

    def plain(n):
        norm = " ".join(n.split())
        hit = next((c for a, c in pairs if a in norm), None)
        return hit or next((c for a, c in pairs if norm and SequenceMatcher(None, norm, a).ratio() >= 0.9), n)

    df = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, merchant_name string")
    got = [r.merchant_name for r in postprocess.canonicalize(df, pairs).orderBy("k").collect()]
    assert got == [plain(n) for n in names] and set(got) & {"King", "Mega", "BHX"}


def plain_rows(lines):
    rows = []
    for h in sorted(lines, key=lambda h: ((h[2] + h[4]) / 2, h[1])):
        if rows:
            top, low = min(x[2] for x in rows[-1]), max(x[4] for x in rows[-1])
            if max(0, min(h[4], low) - max(h[2], top)) >= 0.85 * min(max(1, h[4] - h[2]), max(1, low - top)):
                rows[-1].append(h)
                continue
        rows.append([h])
    out = []
    for row in rows:
        if len(row) == 1:
            out.append(row[0][:5])
            continue
        row = sorted(row, key=lambda h: h[1])
        wide, parts = 5 * statistics.median(h[4] - h[2] for h in row), [[row[0]]]
        for a, b in zip(row, row[1:]):
            parts.append([b]) if b[1] - a[3] > wide else parts[-1].append(b)
        out += [(" ".join(h[0] for h in p), min(h[1] for h in p), min(h[2] for h in p), max(h[3] for h in p), max(h[4] for h in p)) for p in parts]
    return sorted(out, key=lambda h: ((h[2] + h[4]) / 2, h[1]))


def test_visual_rows(spark):
    rng, pages = random.Random(5), []
    for _ in range(150):
        page = []
        for k in range(rng.randrange(0, 14)):
            x, y, w, h = rng.randrange(0, 500), rng.randrange(0, 60), rng.randrange(5, 60), rng.randrange(6, 16)
            page.append((f"t{k}", x, y, x + w, y + h, 0.9, y + h / 2))
        pages.append((page,))
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pages)], f"k int, l array<{ocr.LINE}>")
    got = [[tuple(h)[:5] for h in r.m] for r in df.select("k", ocr.merge_rows(F.col("l")).alias("m")).orderBy("k").collect()]
    assert got == [plain_rows(p[0]) for p in pages]


def plain_cycle(keys, single, several):
    best = None
    for p in range(1, 6):
        i = p
        while i < len(keys):
            start = i
            while i < len(keys) and keys[i] and keys[i] == keys[i - p]:
                i += 1
            if i > start:
                repeats, seed = (i - start) // p + 1, keys[start - p : start]
                if repeats >= (single if p == 1 else several) and (best is None or repeats > best[1]) and (p == 1 or len(set(seed)) > 1):
                    best = (p, repeats, seed[0])
            else:
                i += 1
    return best


def test_cycles(spark):
    rng = random.Random(6)
    seqs = [[rng.choice(["a", "b", "c", ""]) for _ in range(rng.randrange(1, 30))] for _ in range(400)]
    rows = [(g, k, n) for g, s in enumerate(seqs) for k, n in enumerate(s)]
    df = spark.createDataFrame(rows, "g int, pos int, n string").withColumn("key", F.col("n"))
    got = {r.g: (r.period, r.repeats, r.sample) for r in loops.cyclic_runs(df, ["g"], "pos", "n", "key", single=4, cycle=2).collect()}
    want = {g: c for g, s in enumerate(seqs) if (c := plain_cycle(s, 4, 2))}
    assert got == want and len(want) > 50
