"""The training-data operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import collections
import hashlib
import io
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdeéß", k=rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, rng.randint(25, 120)) for _ in range(25)]
    out = list(base)
    for t in base[:8]:
        out.append(t)  # an exact copy
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))  # a near copy
    passage = prose(rng, 60)
    out += [f"{prose(rng, 20)}\n{passage}\t{prose(rng, 20)}" for _ in range(5)]
    out += [None, "", " \n\t ", "one", "two words", "ONE", "a b c d", "A b C d", " x  x", prose(rng, 20_000), "x" * 100_000, "!!! ???"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, ["src0", "b", None][k % 3], k, "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int, spans string").repartition(3).cache()


# --- WARC ---


def test_warc_round_trip(spark):
    from brindle.llm.warc import round_trip

    big, bigger = "ä" * 600, "x" * 200_000
    rows = [(1, "u", big), (2, "u", big), (3, None, big), (4, "u\r\nWARC-Type: x", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", bigger), (8, "u", bigger), (9, "u", bigger + "y")]
    got = round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), payloads=True).collect()
    assert len(got) == len(rows)
    html = {r[0]: (r[2] or "").encode() for r in rows}
    for r in got:
        assert r.payload_bytes == len(html[r.page_id]) and r.payload_digest == hashlib.sha1(html[r.page_id]).hexdigest()
        expected = ("revisit", 3) if r.page_id in (1, 2) else ("response", None)
        assert (r.record_type, r.refers_to) == expected
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == html[r.page_id]
    assert round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    clash = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *(F.lit(0).alias(c) for c in ("payload", "archive", "record_type", "refers_to")))
    assert round_trip(clash).count() == len(rows)


def test_archives_are_read_by_many_tasks(spark, tmp_path):
    from brindle.llm.common import Scratch
    from brindle.llm.warc import read_archives, write_archives

    pages = spark.range(40).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.lit("x"), F.col("id").cast("int") + 10).alias("html")).repartition(4)
    scratch = Scratch(spark, "warc-test")
    archives = scratch.table(write_archives(pages, scratch.path("archives"), 1000), "manifest")
    read = read_archives(archives)
    assert archives.count() > 1 and read.count() == 40
    assert read.select(F.spark_partition_id()).distinct().count() > 1


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_warc_reader_frames_and_verifies(chunk):
    from brindle.llm.warc import WarcError, page_record, read_records

    good = page_record(1, "http://a/", b"line\r\n\r\nWARC/1.1 inside", None) + page_record(2, "http://b/", b"", 1)
    got = list(read_records(io.BytesIO(good), chunk=chunk))
    assert [(r.type, r.payload) for r in got] == [("response", b"line\r\n\r\nWARC/1.1 inside"), ("revisit", b"")]
    wrong = page_record(1, "u", b"payload", None, digest="sha1:" + base64.b32encode(b"0" * 20).decode())
    with pytest.raises(WarcError, match="payload digest"):
        list(read_records(io.BytesIO(wrong), chunk=chunk))
    with pytest.raises(WarcError):
        list(read_records(io.BytesIO(good[:-5]), chunk=chunk))
    with pytest.raises(WarcError):
        list(read_records(io.BytesIO(b"plain text"), chunk=chunk))


# --- HTML ---


def test_html_main_text(spark):
    from brindle.llm.html_text import extract, main_text

    body = "".join(f"<p>Sentence number {k}, with words; and   more\nof them &amp; an&nbsp;end.</p>" for k in range(6))
    page = f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='ad'>Buy now.</div><article><h1>Head</h1>{body}<div class=comments><p>Nice, really.</p></div></article><aside>Side</aside><footer>(c)</footer></body></html>"
    expected = "Head " + " ".join(f"Sentence number {k}, with words; and more of them & an end." for k in range(6))
    assert main_text(page) == expected
    assert main_text(page.replace("<article>", "<div id='content'>").replace("</article>", "</div>")) == expected
    assert main_text("<p>un<b>closed <i>tags<p>next") == "unclosed tags next"
    assert main_text("<script>var a = '<p>no</p>';</script><form>no</form>") == ""
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (3, "u", page), (4, "u", "<div>" * 3000 + "deep, deep text." + "</div>" * 3000)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    assert sorted((r.page_id, r.n_chars == len(r.text)) for r in got) == [(1, True), (2, True), (3, True), (3, True), (4, True)]
    assert {r.text for r in got} == {expected, "", "deep, deep text."}


def test_html_keeps_the_whole_article():
    """Titles and leads outside the body's element, several sections, short sections right in the body."""
    from brindle.llm.html_text import main_text

    says = lambda k: f"Sentence number {k}, with words; and more of them, until it is long enough, and then an end."
    long, short = [says(k) for k in range(17)], [says(k) for k in range(17, 20)]
    of = lambda tag, texts: f"<{tag}>" + "".join(f"<p>{x}</p>" for x in texts) + f"</{tag}>"
    menu, foot = "<nav><ul><li>Home</li></ul></nav>", "<footer>Imprint</footer>"
    nested = f"<html><body>{menu}<article><h1>Title</h1><p>Lead.</p>{of('div', long)}</article>{foot}</body></html>"
    assert main_text(nested) == " ".join(["Title", "Lead.", *long])
    sections = f"<article><h1>Title</h1>{of('section', long)}<section><h2>Two</h2>{of('div', short)}</section></article>"
    assert main_text(f"<html><body>{menu}{sections}{foot}</body></html>") == " ".join(["Title", *long, "Two", *short])
    assert main_text(f"<html><body>{menu}<div>{of('div', long)}{of('section', short)}</div>{foot}</body></html>") == " ".join(long + short)
    assert main_text(f"<html><body>{menu}<h1>Title</h1>{of('div', long)}<ul><li>Point</li></ul>{of('section', short)}{foot}</body></html>") == " ".join(["Title", *long, "Point", *short])


def test_html_self_closing_foreign_elements():
    from brindle.llm.html_text import main_text

    body = "<p>Before it, some words; and more.</p><p>Icon <svg class=icon/> and <math /> stay, with words.</p><p>Between them, words.</p><p>An <svg><text>no</text></svg> end, at last.</p>"
    expected = "Before it, some words; and more. Icon and stay, with words. Between them, words. An end, at last."
    assert main_text(f"<article>{body}</article>") == expected
    assert main_text("<article><p>First, words.</p><svg/><p>Last, words.</p></article>") == "First, words. Last, words."


# --- nearest neighbours ---


def test_html_takes_linear_time():
    """A megabyte of unclosed tags and 50,000 nested ones; a weak mark inside an article yields to its text, a strong one doesn't."""
    import time

    from brindle.llm.html_text import main_text

    for page in ("<a " * 350_000, "<div>" * 50_000 + "<p>x y.</p>", "<div><p>ab.</p>" * 20_000, "<b>" + "<i>" * 30_000 + "<div>" + "</b>" * 30_000):
        began = time.process_time()
        main_text(page)
        assert time.process_time() - began < 10  # seconds; quadratic scans took minutes
    prose_ = "A sentence that says something, and then some more. " * 6
    page = f"<article><h1>T</h1><p>{prose_}</p><div class='share-price related'><p>{prose_}kept</p></div><div class='comments'><p>{prose_}gone</p></div></article>"
    assert "kept" in main_text(page) and "gone" not in main_text(page)
    assert main_text("") == ""


def test_ann_recall_and_order(spark):
    from brindle.llm.ann_forest import neighbours

    x = np.random.default_rng(0).normal(size=(400, 16)).astype(np.float32)
    x[50:120] = x[50]  # many equal vectors
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)]
    bad = [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [None] * 16), (None, [1.0] * 16), (1080, [float("inf")] + [0.0] * 15)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = collections.defaultdict(list)
    for r in neighbours(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    x = x.astype(float)
    assert set(got) == set(range(0, 400, 20))
    hits = 0
    for q, found in got.items():
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        true = np.lexsort((np.arange(400), -s))[:20]
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(abs(s[v] - score) < 1e-12 for _, v, score in found)
        assert [f[1] for f in found] == sorted((f[1] for f in found), key=lambda v: (-s[v], v))
        hits += len(set(true) & {f[1] for f in found})
    assert hits / (20 * len(got)) >= 0.9
    assert neighbours(df.where("vec_id >= 1000"), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours(df.where("vec_id < 3"), F.col("vec_id") % 20 == 0).count() == 2


# --- n-gram Jaccard ---


def shingles(text, n):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows, n, percent):
    sets = [(i, shingles(t, n)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_jaccard_components(spark, docs, texts, n, percent):
    from brindle.llm.ngram_jaccard import jaccard_components

    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, n, percent).collect()}
    assert got == brute_components(list(enumerate(texts)), n, percent)


def test_jaccard_chains_and_dense_groups(spark):
    """Chains of near copies, none near the first, and a group of variants of one text."""
    from brindle.llm.ngram_jaccard import jaccard_components

    rng = random.Random(3)
    words = prose(rng, 200).split()
    rows = []
    for k in range(30):
        rows.append((k, " ".join(words)))
        words = words[4:] + prose(rng, 4).split()
    base = prose(rng, 150).split()
    for k in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        rows.append((100 + k, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert got == brute_components(rows, 4, 85)


def test_jaccard_of_nothing(spark):
    from brindle.llm.ngram_jaccard import jaccard_components, near_duplicates_removed

    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(empty).count() == 0 and near_duplicates_removed(empty).count() == 0
    rows = spark.createDataFrame([(1, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id or -1) for r in near_duplicates_removed(rows).collect()) == [-1, 1, 1]


def test_count_tree_loses_nothing():
    from brindle.llm.ngram_jaccard import CountTree

    rng = np.random.default_rng(1)
    base = rng.poisson(2, (20, 64))
    pts = np.maximum(0, np.repeat(base, 15, 0) + rng.integers(-1, 2, (300, 64)) * (rng.random((300, 64)) < 0.1))
    sizes = pts.sum(1)
    tree = CountTree(pts, sizes, np.arange(300), fanout=4)
    for k in range(0, 300, 7):
        bound = np.minimum(pts, pts[k]).sum(1)
        expected = set(np.flatnonzero((185 * bound >= 85 * (sizes + sizes[k])) & (np.arange(300) != k)))
        assert set(tree.search(pts[k], sizes[k], k, 85)) == expected


# --- language ---


def test_language_mixture(spark):
    from brindle.llm.language_mixture import fit, held_out, identify

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    models = fit(docs.where(~held_out()))
    got = identify(docs.where(held_out()), models).join(docs.select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert got >= 0.97
    by = {r.lang: r.text for r in docs.where("length(text) > 800").groupBy("lang").agg(F.first("text").alias("text")).collect()}
    both = " ".join(by["de"].split()[:60] + by["fr"].split()[:120])
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, both), (5, "и" * 10), (6, "the " * 50_000)]
    out = {r.doc_id: r for r in identify(spark.createDataFrame(rows, "doc_id long, text string"), models).collect()}
    assert [out[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and out[4].lang_pred == "fr" and 0.5 < out[4].score < 0.85 and out[6].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in out.values())
    none = fit(docs.limit(0))
    assert identify(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), none).first().lang_pred == "und"


# --- mixing ---


def test_mixture_depends_on_the_text_alone(spark, docs):
    from brindle.llm.language_mixture import fit, identify

    rows = docs.where("text is not null").withColumn("lang", F.concat(F.lit("l"), F.col("doc_id") % 6))
    models = fit(rows)
    together = {r.doc_id: r.mixture for r in identify(docs, models).collect()}
    alone = {r.doc_id: r.mixture for r in identify(docs.repartition(50), models).collect()}
    assert together == alone and len(models.languages) == 6
    assert identify(docs.limit(0), models).count() == 0


def test_mix_targets_and_limits(spark, docs, texts, monkeypatch):
    """Targets and the words taken of each document, against a sequential schedule of the same points."""
    from brindle.llm import source_mixing
    from brindle.llm.source_mixing import mix, mixed, taken

    sizes = [len(WORD.findall(t or "")) for t in texts]
    rows = taken(*mix(docs)).collect()
    assert {r.doc_id: r["size"] for r in rows} == dict(enumerate(sizes))
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    names = ["b", "src0", None]
    total = {s: sum(n for k, n in enumerate(sizes) if ["src0", "b", None][k % 3] == s) for s in names}
    goal, free = dict.fromkeys(names, 0.0), dict(zip(names, (5, 2, 1)))
    while True:
        rest = 1.5 * sum(sizes) - sum(2 * total[s] for s in names if s not in free)
        over = [s for s in free if rest * free[s] / sum(free.values()) > 2 * total[s]]
        if not over:
            break
        for s in over:
            goal[s] = 2 * total[s]
            del free[s]
    for s in free:
        goal[s] = rest * free[s] / sum(free.values())
    words = sum(goal.values())
    block = max(1, int(words // (1 << 17)))
    slots = max(1, round(words / block))
    ends = np.cumsum([goal[s] / words for s in names])
    points = (np.arange(slots) + 0.5) * 0.6180339887498949 % 1
    hits = np.bincount(np.minimum(np.searchsorted(ends, points, "right"), 2), minlength=3)
    for k, s in enumerate(names):
        own = sorted((r for r in rows if r.source == s), key=lambda r: (r.shuffle, r.doc_id))
        assert abs(own[0].target - goal[s]) < 1e-6 and own[0].source_size == total[s]
        take = min(int(hits[k]) * block, 2 * total[s])
        assert abs(take - goal[s]) <= 5 * block
        at = 0
        for r in own:
            assert r.taken == sum(max(0, min(x + r["size"], take) - x) for x in (at, at + total[s]))
            at += r["size"]
    monkeypatch.setattr(source_mixing, "GOLDEN", 0.0001)
    assert {r.doc_id: r.taken for r in taken(*mix(docs)).collect()} != {r.doc_id: r.taken for r in rows}
    monkeypatch.undo()
    again = {r.doc_id: r.taken for r in taken(*mix(docs.repartition(7))).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
    words = collections.Counter()
    clash = docs.select("*", *(F.lit(0).alias(c) for c in ("size", "taken", "row", "slot", "shuffle", "target", "start", "words", "epoch")))
    assert mixed(clash).columns == clash.columns
    for r in mixed(clash).collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert dict(words) == {r.doc_id: r.taken for r in rows if r.taken}
    assert taken(*mix(docs.limit(0))).count() == 0


# --- lines ---


def test_line_dedup(spark):
    from brindle.llm.line_dedup import dedup_lines

    rng = random.Random(9)
    long = prose(rng, 80)
    near = " ".join([*long.split()[:-1], "other"])
    rows = [
        (1, f"{long}\n\nfirst, own LINE!\nsame line\nsame line"), (2, f"second own line\n{near}\n---"), (3, "Same  Line"), (4, None), (5, ""),
        (6, "\n".join(["---", "first own line", "third one entirely"])), (None, "same line\nwithout an id"), (7, "third one entirely\r\nlast line of all"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("line", "sim", "n_lines", "n_removed", "hash", "doc", "pos", "label", "gone", "row", "spans", "size"):
        df = df.withColumn(c, F.lit("clash"))
    plain = dedup_lines(df, counts=False)
    assert plain.columns == df.columns and plain.first().n_lines == "clash"
    got = {r.doc_id: r for r in dedup_lines(df).collect()}
    assert got[1].text == f"{long}\n\nfirst, own LINE!\nsame line" and (got[1].n_lines, got[1].n_removed) == (5, 1)
    assert got[2].text == "second own line\n---"
    assert got[3].text == "" and got[4].text is None and got[5].text == "" and got[6].text == "---\nthird one entirely"
    assert got[None].text == "without an id" and got[7].text == "last line of all"
    left = {r.doc_id for r in dedup_lines(df, drop_emptied=True, counts=False).collect()}
    assert left == {1, 2, 4, 5, 6, 7, None}
    assert dedup_lines(df.limit(0)).count() == 0
    many = spark.createDataFrame([(1, "\n".join(f"line {k % 500} of many" for k in range(3000)))], "doc_id long, text string")
    assert len(dedup_lines(many, similarity=1.0).first().text.split("\n")) == 500


def test_line_dedup_runs_no_python(spark, monkeypatch):
    """No step of line dedup runs Python on the executors."""
    from brindle.llm.common import Scratch
    from brindle.llm.line_dedup import dedup_lines

    plans, make = [], Scratch.table

    def table(self, df, name, *rest, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return make(self, df, name, *rest, **options)

    monkeypatch.setattr(Scratch, "table", table)
    df = spark.createDataFrame([(1, "one line of words"), (2, "one line of words")], "doc_id long, text string")
    out = dedup_lines(df)
    assert [r.n_removed for r in out.orderBy("doc_id").collect()] == [0, 1]
    assert plans and not any(x in p for p in plans for x in ("Arrow", "Python", "Pandas"))


def test_line_keys_move_once(spark, monkeypatch):
    """Keys of two lines need one exchange and no join; lines that hold a key twice are found."""
    from brindle.llm.common import Scratch
    from brindle.llm.line_dedup import dedup_lines

    plans, make = {}, Scratch.table

    def table(self, df, name, *rest, **options):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return make(self, df, name, *rest, **options)

    monkeypatch.setattr(Scratch, "table", table)
    rng = random.Random(12)
    rows = []
    for k in range(30):  # three to five near copies of lines that repeat their words, so keys have two lines and more
        w = prose(rng, 6).split() * rng.randint(2, 6)
        for j in range(rng.randint(3, 5)):
            v = list(w)
            for _ in range(len(w) // 12):
                v[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((100 * j + k, " ".join(v)))
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k for k, v in got.items() if v} == set(range(30))
    assert "Join" not in plans["sums-0"] and plans["sums-0"].count("Exchange hashpartitioning") == 1


def test_lines_are_normalised_by_texts(spark, monkeypatch):
    """Other characters go by one search a text, not by a split of each line; long periodic lines, and words between any other characters, are told apart as before."""
    from brindle.llm.common import Scratch
    from brindle.llm.line_dedup import dedup_lines

    plans, make = {}, Scratch.table

    def table(self, df, name, *rest, **options):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return make(self, df, name, *rest, **options)

    monkeypatch.setattr(Scratch, "table", table)
    own, other = " ".join(["one", "two", "three"] * 300), " ".join(["four", "five"] * 300)
    near = " ".join(["one", "two", "three"] * 299 + ["x", "y", "z"])
    rows = [(1, own), (2, other), (3, near), (4, "Mixed,\tÉcole\u00a0no.7 of\rmany words here"), (5, "mixed école!? (no) 7 of  many words\u2003here")]
    got = {r.doc_id: r.n_removed for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 0, 5: 1}
    assert "regexp_replace" in plans["occurrences"]


def test_line_candidates_with_a_small_vocabulary(spark, monkeypatch):
    """Unrelated lines of few words hardly meet, and what told lines apart goes before they are compared."""
    from brindle.llm import line_dedup
    from brindle.llm.common import Scratch

    rng = random.Random(4)
    vocabulary = [f"w{k}x" for k in range(60)]
    lines = [" ".join(rng.choices(vocabulary, k=20)) for _ in range(1500)]
    lines += [" ".join(x if k != 7 else "other" for k, x in enumerate(line.split())) for line in lines[:700]]
    seen, held, make, drop = {}, set(), Scratch.table, Scratch.drop

    def table(self, df, name, *rest, **options):
        out = make(self, df, name, *rest, **options)
        held.add(name)
        assert not (name.startswith(("met", "links", "more")) and "occurrences" in held)
        seen[name] = out.count()
        return out

    def dropped(self, *names):
        held.difference_update(names)
        drop(self, *names)

    monkeypatch.setattr(Scratch, "table", table)
    monkeypatch.setattr(Scratch, "drop", dropped)
    df = spark.createDataFrame([(k, line) for k, line in enumerate(lines)], "doc_id long, text string")
    assert {r["doc_id"] for r in line_dedup.dedup_lines(df).where("n_removed > 0").collect()} == set(range(1500, 2200))
    assert seen["asked"] + seen.get("open", 0) < 8000
    # by slices too
    monkeypatch.setattr(line_dedup, "SLICE", 500)
    monkeypatch.setattr(line_dedup, "SMALL", 3)
    seen.clear()
    assert {r["doc_id"] for r in line_dedup.dedup_lines(df).where("n_removed > 0").collect()} == set(range(1500, 2200))
    assert {"links-1", "more-1"} & set(seen)


def test_unlike_lines_with_common_keys_are_dropped_by_sketches(spark, monkeypatch):
    """Words of lines that share a rare passage and nothing else don't move, and keys are made without an array of numbers a line."""
    from brindle.llm.common import Scratch
    from brindle.llm.line_dedup import dedup_lines

    plans, seen, make = {}, {}, Scratch.table

    def table(self, df, name, *rest, **options):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        out = make(self, df, name, *rest, **options)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "table", table)
    rng = random.Random(8)
    words = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    lines = []
    for of in (2, 2, 2, 2, 30):  # a passage in two lines, listed as pairs, and in many
        for _ in range(20 if of == 2 else 2):
            passage = words(16)
            lines += [" ".join([*words(7), *passage, *words(7)]) for _ in range(of)]
    near = [" ".join(["other", *x.split()[1:-3], *words(3)]) for x in lines[:25]]
    df = spark.createDataFrame(list(enumerate(lines + near)), "doc_id long, text string")
    assert {r.doc_id for r in dedup_lines(df).where("n_removed > 0").collect()} == set(range(len(lines), len(lines) + 25))
    assert seen["asked"] >= 80 and seen["strings"] <= 60 and seen.get("few", 0) <= 10
    assert not any(x in plans["sums-0"] for x in ("transform(", "sort_array("))


def test_near_lines_are_found(spark):
    """Lines of 100 words with one changed go; unlike lines of a similar vocabulary stay."""
    from brindle.llm.line_dedup import dedup_lines

    rng = random.Random(11)
    rows, pairs = [], 60
    for k in range(pairs):
        w = prose(rng, 100).split()
        rows.append((k, " ".join(w)))
        w[rng.randrange(100)] = "zzz"
        rows.append((1000 + k, " ".join(w)))
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] for k in range(pairs))
    assert not any(got[1000 + k] for k in range(pairs))


def test_large_meetings_lose_no_link(spark, monkeypatch):
    """Lines of one key in several components, and a long chain, against brute force; with salted keys too."""
    from brindle.llm import line_dedup

    monkeypatch.setattr(line_dedup, "CHUNK", 7)
    rng = random.Random(4)
    head = [f"h{k}" for k in range(6)]
    lines = [[*head, *(f"x{rng.randrange(3)}" for _ in range(6))] for _ in range(150)]
    chain = [f"c{k}" for k in range(20)]
    for k in range(60):
        lines.append(list(chain))
        chain[k % 20] = f"d{k}"
    rows = [(k, " ".join(w)) for k, w in enumerate(lines)]
    label = list(range(len(lines)))
    for i, a in enumerate(lines):
        for j, b in enumerate(lines[:i]):
            if len(a) == len(b) and sum(x != y for x, y in zip(a, b)) <= 0.2 * len(a):  # the vocabulary makes shifts no shorter
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    expected = {k: x for k, x in enumerate(label) if label.count(x) > 1}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (line_dedup.HOT, 20):
        monkeypatch.setattr(line_dedup, "HOT", hot)
        found = line_dedup.dedup_lines(df)
        left = {r.doc_id for r in found.where("text <> ''").collect()}
        assert left == {min(k for k, x in enumerate(label) if x == y) for y in set(label)}
    assert len(expected) > 100


def test_near_lines_match_brute_force(spark):
    """Each pair at the threshold or above is found, near and far from it, with short and long lines."""
    from brindle.llm.line_dedup import line_groups

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(5)
    rare = lambda: f"w{rng.randrange(10**6)}"
    word = lambda: rng.choice("the of and to in".split()) if rng.random() < 0.3 else rare()
    lines, planted = [], 0
    for n in (3, 4, 5, 6, 9, 10, 14, 20, 24, 25, 40):
        for edits in range(n // 5 + 2):
            for kind in ("change", "drop", "add", "mixed"):
                w = [word() for _ in range(n)]
                v = list(w)
                for at in sorted(rng.sample(range(n), edits), reverse=True):
                    how = rng.choice(("change", "drop", "add")) if kind == "mixed" else kind
                    v[at : at + (how != "add")] = [] if how == "drop" else [rare()]
                lines += [(len(lines), " ".join(w)), (len(lines) + 1, " ".join(v))]
    for similarity in (0.8, 0.6):
        groups = line_groups(spark.createDataFrame(lines, "doc_id long, text string"), similarity)
        label = {r.first_doc: r.label for r in groups.collect()}
        for k in range(0, len(lines), 2):
            a, b = lines[k][1].split(), lines[k + 1][1].split()
            near = distance(a, b) <= (1 - similarity) * max(len(a), len(b)) + 1e-9
            planted += near
            assert (k in label) == near, (similarity, a, b)
            assert k + 1 not in label
    assert planted > 150


# --- byte-level BPE ---


def test_bpe_equals_the_library(spark, docs, texts):
    import public_tokenizers as P
    import tiktoken

    from brindle.llm.byte_bpe import Tokenizer, decode, digests, encode

    path = P.path("byte_bpe_50k.tiktoken")
    tok = Tokenizer(path)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tok.ranks, special_tokens={})
    rng = random.Random(1)
    parts = ["a", "s", "t", "re", "ve", "ll", "'", "'s", "'ll", " ", "  ", "\n", "\t", " ", "é", "Ö", "1", "²", "!", "…", "中", "😀", "　", "\x1c", "_", "m", "d", "\r\n", "<|endoftext|>", "\x00"]
    cases = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(5000)] + ["a" * 3000, "ab" * 300, " " * 500, "\n" * 77 + "x"]
    for k in range(0, len(cases), 500):
        assert tok.encode_batch(cases[k : k + 500]) == [enc.encode_ordinary(t) for t in cases[k : k + 500]]
    own = encode(docs, path)
    for r in own.collect():
        t = texts[r.doc_id] or ""
        assert r.ids == enc.encode_ordinary(t)
        ends = [*r.offsets[1:], len(t.encode())]
        assert all(tok.bytes[i] == t.encode()[a:b] for i, a, b in zip(r.ids, r.offsets, ends))
    assert {r.doc_id: r.text for r in decode(own, path).collect()} == {k: t or "" for k, t in enumerate(texts)}
    for r in digests(docs, path).collect():
        ids = enc.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest())


# --- quality ---


def test_quality_figures_and_order(spark, docs, texts):
    from brindle.llm.quality_rules import RULES, keep_good, ordered, score

    got = {r.doc_id: r for r in score(docs).collect()}
    for k, t in enumerate(texts):
        w = WORD.findall(t or "")
        windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        repeat = [any(windows[tuple(w[j : j + 8])] > 1 for j in range(max(0, i - 7), min(i, len(w) - 8) + 1)) for i in range(len(w))]
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), sum(repeat))
        assert r.base_failed == (len(w) < 20 or 100 * sum(repeat) > 30 * len(w)) and (not r.kept or not r.base_failed)
    assert {r.doc_id for r in keep_good(docs).collect()} == {k for k, r in got.items() if r.kept}
    assert keep_good(docs).columns == docs.columns
    reverse = {r.doc_id: r.kept for r in score(docs, rules=list(reversed(RULES)), sample_rows=3).collect()}
    assert reverse == {k: r.kept for k, r in got.items()}
    order = ordered(RULES[:3], {RULES[0].name: (0.1, 1.0), RULES[1].name: (0.5, 2.0), RULES[2].name: (0.0, 0.1)})
    assert [r.name for r in order] == [RULES[1].name, RULES[0].name, RULES[2].name]
    junk = spark.createDataFrame([(1, "w### x*** y$$$ " * 9 + prose(random.Random(1), 30)), (2, "SHOUT NOW " * 2 + prose(random.Random(2), 20).upper() + "!!" * 9), (3, prose(random.Random(3), 60))], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in score(junk).collect()} == {1: False, 2: False, 3: True}
    assert score(docs.limit(0)).count() == 0


# --- substrings ---


@pytest.mark.parametrize("batch", [2_000, 8_000_000])
def test_substring_dedup(spark, docs, texts, batch):
    from brindle.llm import substring_dedup

    width = 13
    first, words = {}, {k: WORD.findall(t or "") for k, t in enumerate(texts)}
    for k, w in words.items():
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), k)
    got = {r.doc_id: r for r in substring_dedup.strip_repeats(docs, width, batch=batch).collect()}
    for k, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < k:
                gone[i : i + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert (got[k].n_words, got[k].n_removed, got[k].kept_text, got[k].kept_sha256) == (len(w), sum(gone), kept, hashlib.sha256(kept.encode()).hexdigest())
    assert substring_dedup.strip_repeats(docs.limit(0), width).count() == 0


# --- components, pipeline, entry ---


def test_components(spark):
    from brindle.llm.common import Scratch
    from brindle.llm.graph import components

    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(500, 501), (501, 500), (7, 7), (600, 500)], "a long, b long"))
    got = {r.node: r.label for r in components(edges, Scratch(spark, "test"), "x").collect()}
    assert got == {**{k: 0 for k in range(301)}, 500: 500, 501: 500, 600: 500}
    assert components(edges.limit(0), Scratch(spark, "test"), "y").count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(2)
    a, b = prose(rng, 200), prose(rng, 150)
    rows = [(1, a), (2, a), (3, b), (4, "junk " * 50), (5, None), (6, prose(rng, 90).replace(" ", "\n", 5)), (7, re.sub(r"((?:\S+ ){9}\S+) ", r"\1\n", b))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        at = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r.doc_id for r in at.select("doc_id").collect()})
    assert kept[0] == {1, 2, 3, 6, 7} and kept[1] == {1, 3, 6, 7} and kept[2] == {1, 3, 6}
    assert at.columns == ["doc_id", "n_tokens", "ids"] and at.where("n_tokens <> size(ids)").count() == 0
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in run.select("doc_id").distinct().collect()} == kept[-1]


def test_every_operator_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
