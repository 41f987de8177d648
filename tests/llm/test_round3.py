"""URL filter, importance resampling and embedding whitening against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import common, importance, jaccard, toxicity, url_filter, whitening

PAGES = "page_id long, url string, html string, host string, rule string, component string"
RULES = [*url_filter.RULES, ("block", "bad.org", "/"), ("allow", "bad.org", "/good/"), ("block", "x.bad.org", "/good/x"), ("block", "dup.org", "/"), ("allow", "dup.org", "/"), (None, "org", "/"), ("block", None, "/")]


def canonical(href):
    return f'<html><head><LINK data-x="1" rel="canonical" href="{href}"></head>'


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    rows = [
        (1, "http://bad.org/a", None), (2, "https://bad.org/good/1", ""), (3, "http://X.Bad.org/good/x1#f", "<p>"), (4, "http://notbad.org/a", ""),
        (5, "http://alias.org/1", canonical("http://bad.org/a?utm_source=z")),  # blocked through its canonical address
        (6, "http://far.org/2", '<meta http-equiv=\'Refresh\' content="0; URL=http://alias.org/1#top">'),  # and one step further
        (7, "http://both.org/", canonical("http://bad.org/a")), (7, "http://both.org/", canonical("http://bad.org/a")),
        (8, "http://mixed.org/", canonical("http://www.example.com/en/")), (9, "http://other.org/", canonical("http://mixed.org")),
        (10, "http://dup.org/x", ""), (11, None, canonical("http://bad.org/a")), (12, "no scheme", canonical("http://bad.org/a")), (None, "http://bad.org:80/a", ""),
        (14, "http://rel.org/a/b/c", canonical("../x")), (15, "http://rel.org/a/b/../x", canonical("//bad.org/a")), (16, "http://self.org/", canonical("#x")),
        (17, "ftp://bad.org/a", ""), (28, "http://out.org/", canonical("http://nowhere.example.net/fr/x")), (18, "http://user@bad.org:80/a", ""), (19, "http://q.org/p?b=1&utm_medium=x&c=2", canonical("?b=1&amp;c=2")),
        (20, "https://q.org/p?b=1&c=2", canonical("http://bad.org/a")), (21, "http://bad.org", ""), (22, "http://bad.org?x=/", ""), (23, "http:///p", canonical("http://bad.org/a")),
        (24, "http://deep.a.b.c.d.e.net/fr/1", ""), (25, "http://net/fr/", canonical("")), (26, "http://.net/fr/", ""), (27, "http://m.org/" + "y" * 5000, "<link " * 5000)]
    rows += [(100 + i, f"http://star{i}.org/", canonical("http://hub.org/")) for i in range(40)] + [(99, "http://hub.org/", canonical("http://bad.org/a"))]
    path = str(tmp_path_factory.mktemp("pages") / "pages.parquet")
    spark.createDataFrame([(*r, "h", "r", "c") for r in rows], PAGES).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def brute_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute_address(url):
    if not re.match("(?i)https?://", url or ""):
        return None
    host, path = brute_host_path(url)
    host = re.sub(r":(80|443)?$", "", host.rsplit("@", 1)[-1])
    query = re.search(r"\?(.*)$", re.sub("#.*", "", url.split("://", 1)[1]))
    kept = [x for x in (query.group(1) if query else "").split("&") if not re.match("(?i)(utm_[a-z]+|gclid|fbclid|msclkid|mc_eid)=", x)]
    return (host + (path or "/") + ("?" + "&".join(kept) if "".join(kept) else "")) if host else None


def brute_judge(rows, rules, redirects=()):
    edges, adopted = [], {}
    for _, url, html in rows:
        if not url or "://" not in url:
            continue
        host, path = brute_host_path(url)
        for tag in re.findall(r"(?i)<(?:link|meta)\s[^<>]*>", html or ""):
            m = re.search(r"""(?i)\shref=["']?([^\s"'<>]+)""", tag) if re.search(r"""(?i)\srel=["']?canonical""", tag) else None
            m = m or (re.search(r"""(?i)url=["']?([^\s"'<>]+)""", tag) if re.search("(?i)refresh", tag) else None)
            if not m:
                continue
            link = m.group(1).replace("&amp;", "&")
            folder = path[: path.rfind("/") + 1] or "/"
            target = (link if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", link) else "http:" + link if link.startswith("//") else url if link.startswith("#")
                      else "http://" + host + ("" if link[0] == "/" else path if link[0] == "?" else folder) + link)
            edges.append((url, target))
    for a, b in [*edges, *redirects]:
        a, b = brute_address(a), brute_address(b)
        if a and b and a != b:
            adopted.setdefault(a, a), adopted.setdefault(b, b)
            a, b = adopted[a], adopted[b]
            for k, v in adopted.items():
                if v == b:
                    adopted[k] = a
    judged, says = [], defaultdict(set)
    ends = [(None, u, "end") for pair in [*edges, *redirects] if brute_address(pair[0]) and brute_address(pair[1]) for u in pair]
    for id_, url, html in [*rows, *ends]:
        host, path = brute_host_path(url)
        fit = [(len(h + p), len(h), a == "allow", h + p, a) for a, h, p in rules if None not in (a, h, p) and (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, action = max(fit)[3:] if fit else (None, None)
        node = brute_address(url)
        class_ = adopted.get(node, node)
        if html != "end":
            judged.append((id_, host, path, rule, action, class_))
        if action and class_:
            says[class_].add(action)
    return Counter((i, h, p, r, a or (min(says[c]) if c and says[c] else "allow")) for i, h, p, r, a, c in judged)


@pytest.mark.parametrize("redirects", [None, [("http://star3.org/", "http://mixed.org/"), ("http://m.org/q", None), (None, "http://m.org/q")]])
def test_url_filter(spark, pages, redirects):
    table = spark.createDataFrame(redirects, "url string, target string") if redirects else None
    out = url_filter.judge(pages, url_filter.rules_table(spark, RULES), table)
    assert out.columns == ["page_id", "host", "path", "rule", "verdict", "alias_verdict"]
    got = {**Counter(tuple(r)[:5] for r in out.collect())}
    want = brute_judge([(r.page_id, r.url, r.html) for r in pages.collect()], RULES, [r for r in redirects or []])
    assert got == {**want}
    by_id = {r.page_id: r for r in out.collect()}
    hub = "allow" if redirects else "block"  # the explicit allow of an alias comes first
    assert [by_id[i].verdict for i in (5, 6, 7, 8, 9, 99, 139, 28)] == [hub, hub, hub, "allow", "allow", hub, hub, "block"] and by_id[1].verdict == "block"


def test_url_filter_sql(spark, pages):
    import duckdb

    con = duckdb.connect()
    con.register("pages", pages.toArrow())
    found = con.execute(url_filter.OP11_SQL).fetchall()
    out = url_filter.judge(pages, url_filter.rules_table(spark)).drop("alias_verdict")
    assert Counter(found) == Counter(map(tuple, out.collect()))


def test_url_filter_without_rows_or_rules(spark, pages):
    assert url_filter.judge(pages.limit(0), url_filter.rules_table(spark)).collect() == []
    assert {(r.rule, r.verdict) for r in url_filter.judge(pages, url_filter.rules_table(spark, [])).collect()} == {(None, "allow")}


TEXTS = [(1, "The cat sat on the mat. " * 4), (2, "dog DOG dog " * 9), (2, "dog DOG dog " * 9), (None, "null id " * 20), (3, None), (4, ""), (5, "ünï çödé x1y2 " * 10), (6, "!!! ... "),
         (7, "w " * 19), (8, "w " * 20), (9, "hot " * 5000), *((100 + i, " ".join(f"t{(i * j) % 37}" for j in range(30))) for i in range(60))]


def brute_resample(docs, target, least=1, most=1, buckets=10000, percent=10, min_words=20, seed=2024):
    def grams(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(least, most + 1) for i in range(len(w) - n + 1)]

    own, theirs = [grams(t) for _, t in docs], [g for t in target for g in grams(t)[1]]
    s, t = Counter(g for _, o in own for g in o), Counter(theirs)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + buckets) / ((s[b] + 1.0) * (t.total() + buckets))))
    rows = []
    for (id_, _), (n, feats) in zip(docs, own, strict=True):
        weight = sum(map(gain, feats))
        h = int(hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).hexdigest()[:8], 16)
        rows.append([id_, len(feats), n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    can = sorted((r for r in rows if r[2] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for place, r in enumerate(can[: percent * len(can) // 100], 1):
        r.append(place)
    return Counter((r[0], r[1], r[3], r[4], r[5] if len(r) > 5 else None) for r in rows)


@pytest.mark.parametrize("options", [{}, {"least": 1, "most": 3, "buckets": 64, "percent": 50}, {"percent": 100, "min_words": 1}])
def test_importance(spark, tmp_path, options):
    spark.createDataFrame([(i, t, "r", 1, 2.0) for i, t in TEXTS], "doc_id long, text string, rank string, bucket int, weight double").repartition(4).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    target = spark.createDataFrame([("the dog sat",), (None,), ("ünï t5 t7",)], "text string")
    out = importance.resample(docs, target, **options)
    got = Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out.collect())
    assert got == brute_resample(TEXTS, ["the dog sat", None, "ünï t5 t7"], **options)


def test_importance_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    assert importance.resample(docs, docs).collect() == []
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(str(tmp_path / "e"))
    out = importance.resample(spark.read.parquet(str(tmp_path / "e")), docs)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out.collect()) == brute_resample(TEXTS, [])


def write_vectors(spark, path, vectors):
    rows = [(i if i % 7 else None, v, 1, 2.0) for i, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int, whitened double").repartition(3).write.parquet(path)
    return spark.read.parquet(path), rows


def usable(rows, dims):
    return [(i, tuple(math.floor(256 * c) for c in v)) for i, v, *_ in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) and abs(256 * c) < 2**63 for c in v)]


def brute_covariance(x):
    n, d = len(x), len(x[0])
    mean = [Fraction(sum(v[j] for v in x), n) for j in range(d)]
    return [[sum((v[i] - mean[i]) * (v[j] - mean[j]) for v in x) / n for j in range(d)] for i in range(d)]


def test_whitening(spark, tmp_path):
    rng = np.random.default_rng(3)
    scale = np.array([1e6, 30, 4, 1, 0.2, 5])  # columns of very different size, far from zero
    vectors = (rng.normal(size=(150, 6)) * scale + 1e7).tolist()
    vectors += [vectors[0]] * 50 + [None, [], [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5, [1e300] + [0.0] * 5, [1.0, 2.0]]
    table, rows = write_vectors(spark, str(tmp_path / "v"), vectors)
    good = usable(rows, 6)
    x = sorted({v for _, v in good})
    model = whitening.fit(table)
    exact = brute_covariance(x)
    n, sums = len(x), [sum(v[j] for v in x) for j in range(6)]
    assert model["n"] == n and model["sums"] == sums
    high, low = whitening.covariance(*_stored(table, tmp_path), whitening.mean_of(n, sums), str(tmp_path / "c"))
    for i in range(6):
        for j in range(6):
            scale_ij = math.sqrt(exact[i][i] * exact[j][j])
            assert abs(Fraction(high[i, j]) + Fraction(low[i, j]) - exact[i][j]) <= 1e-28 * scale_ij  # far beyond doubles
    values = np.linalg.eigvalsh(np.array(exact, dtype=float))[::-1]
    assert np.allclose(model["eigenvalues"], values[:4], rtol=1e-9) and model["identity_error"] < 1e-6
    out = whitening.whiten(table, model).collect()
    assert len(out) == 4 * len(good)
    exact_dev = [(i, sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))) for i, v in good for _ in range(4)]
    assert any(d >= 2**63 for _, d in exact_dev) and any(d < 2**63 for _, d in exact_dev)
    assert Counter((r.vec_id, r.deviation) for r in out) == Counter((i, d if d < 2**63 else None) for i, d in exact_dev)
    assert all(abs(r.explained - values[r.component - 1] / values.sum()) < 1e-12 for r in out)
    projected = whitening._whitened(np.array(x), model)
    assert np.abs(projected.T @ projected / n - np.eye(4)).max() < 1e-6


def _stored(table, tmp_path):
    rows, dims = whitening.fit_list(table, "embedding", str(tmp_path / "fit"))
    n, _ = whitening.sums(rows, dims)
    return rows, n


def test_whitening_merges_in_levels(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rng = np.random.default_rng(4)
    parts = [(rng.normal(size=4), rng.normal(size=4) * 1e-20) for _ in range(9)]
    rows = spark.createDataFrame([(bytearray(a.tobytes()), bytearray(b.tobytes())) for a, b in parts], "high binary, low binary").repartition(9)
    high, low = whitening.merged(rows, 4, str(tmp_path / "m"))
    for i in range(4):
        want = sum(Fraction(a[i]) + Fraction(b[i]) for a, b in parts)
        assert abs(Fraction(high[i]) + Fraction(low[i]) - want) < 1e-28


def test_whitening_of_few_vectors(spark, tmp_path):
    table, _ = write_vectors(spark, str(tmp_path / "a"), [])
    assert whitening.whiten(table, whitening.fit(table)).collect() == []
    table, _ = write_vectors(spark, str(tmp_path / "b"), [[1.0, 2.0, 3.0]] * 3)
    out = whitening.whiten(table, whitening.fit(table)).collect()
    assert len(out) == 9 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in out} == {(1, 0, None, 0.0, 0.0)}
    table, _ = write_vectors(spark, str(tmp_path / "c"), [[1.0, 2.0], [3.0, 6.0], [5.0, 10.0], [0.0, 1.0, 2.0]])
    out = whitening.whiten(table, whitening.fit(table)).collect()
    assert len(out) == 6 and {(r.component, round(r.explained, 9), r.whitened is None) for r in out} == {(1, 1.0, False), (2, 0.0, True)}


def test_a_compaction_that_is_cut_short(spark, tmp_path, monkeypatch):
    """Whatever step fails, the next compaction counts every row once."""
    from lodestone.llm import exact_dedup

    monkeypatch.setattr(exact_dedup, "FANOUT", 3)
    index = exact_dedup.MergeIndex(spark, str(tmp_path / "index"), "bigint")
    want, step, real = Counter(), 0, exact_dedup.delete_path
    write = exact_dedup.MergeIndex._write

    def failing(self, *args):
        raise OSError("lost")

    for batch, broken in enumerate([None, "write", "delete", None, "delete", "write"]):
        rows = [(10 * batch + i, f"text {i % (batch + 2)}") for i in range(8)]
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / f"d{batch}"))
        index.flush(spark.read.parquet(str(tmp_path / f"d{batch}")))
        want.update(t for _, t in rows)
        monkeypatch.setattr(exact_dedup, "delete_path", failing if broken == "delete" else real)
        monkeypatch.setattr(exact_dedup.MergeIndex, "_write", failing if broken == "write" else write)
        for _ in range(2):
            try:
                index.compact()
            except OSError:
                step += 1
            monkeypatch.setattr(exact_dedup, "delete_path", real)
            monkeypatch.setattr(exact_dedup.MergeIndex, "_write", write)
        index.compact()
        assert sorted(r.group_size for r in index.entries().collect()) == sorted(want.values()), batch
    assert step >= 3


def test_salvage_of_version_lines_is_linear():
    import time

    from lodestone.llm import warc

    start = time.perf_counter()
    for line in (b"WARC/1.0\r\n", b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n"):
        data = line * ((16 << 20) // len(line))
        assert [(k, a, b) for k, a, b, *_ in warc.salvage(data)] == [("gap", 0, len(data))]
    good = warc.response(1, "http://a/", b"body", hashlib.sha1(b"body").hexdigest(), None, False)
    found = list(warc.salvage(b"WARC/1.0\r\n" * 1000 + good + b"WARC/1.0\r\nX: y\r\n" + good))
    assert [k for k, *_ in found] == ["gap", "record", "gap", "record"]
    assert time.perf_counter() - start < 30


def test_a_document_of_many_values_is_not_paired_word_by_word(spark, tmp_path):
    """4,000 addresses and as many words in one text: the pairs do not grow with their product."""
    import time

    from lodestone.llm import pii

    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda i: "w" + "".join(letters[(i // 26**k) % 26] for k in range(4))
    rows = [(0, " ".join(f"{word(i)} user{i}@host{i}.example.com" for i in range(4000)))] + [(i, f"plain text number {word(i % 50)}") for i in range(1, 300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    pii.sanitise(docs.limit(5)).count()  # warm
    start = time.perf_counter()
    out = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert time.perf_counter() - start < 60
    assert "@" not in out[0] and out[0].count("[EMAIL]") == 4000 and out[7] == rows[7][1]


def test_slices_by_tokens():
    sets = [[1], [2] * 5, [3] * (jaccard.SLICE_TOKENS + 1), [], [4] * (jaccard.SLICE_TOKENS - 1), [5], [6]]
    none = pa.array([0] * len(sets))
    part = pa.RecordBatch.from_arrays([none] * 5 + [pa.array(sets, pa.list_(pa.int64()))], list("abcdef"))
    slices = [p for (p,) in jaccard._by_tokens(part)]
    assert [p.num_rows for p in slices] == [2, 1, 3, 1]
    assert [x for p in slices for x in p.column(5).to_pylist()] == sets
    assert list(jaccard._by_tokens(part.slice(0, 0))) == []


def test_memo_of_words_goes_with_other_operators():
    trees = toxicity.Trees().fit(np.array([[0.0] * len(toxicity.FEATURES), [1.0] * len(toxicity.FEATURES)] * 50), np.array([0.0, 1.0] * 50))
    one, two = (toxicity.Model({}, trees, np.array([0.0]), np.array([0.5])) for _ in range(2))
    batch = pa.RecordBatch.from_arrays([pa.array(["some words here"])], ["text"])
    one.score(["some words here"])
    assert set(common.WORKER_CACHES["toxicity"][1]) == {"some", "words", "here"}
    two.score(["other"])
    assert common.WORKER_CACHES["toxicity"][0] is two and set(common.WORKER_CACHES["toxicity"][1]) == {"other"}
    list(common.steps([batch], cache="toxicity"))
    assert "toxicity" in common.WORKER_CACHES
    list(common.steps([batch]))
    assert "toxicity" not in common.WORKER_CACHES
