"""The corpus operators against brute force, round trips and hand-made cases: nulls, blanks, ties, repeated rows, empty tables,
and extra columns with names the operators use themselves."""

import math
import random
import tarfile
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import html, langid, media, mixing, packing, quality, simhash, tokens, toxicity, urls
from ledgerlens.llm.queries import URL_RULES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, quality string, fp string, key string"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))


def docs_of(spark, texts, langs=None, sources=None):
    rows = [(i, t, (langs or ["en"] * len(texts))[i], (sources or ["s"] * len(texts))[i], 0, "x", "x", "x", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    made = [" ".join(r.choice(words) for _ in range(r.randint(1, 120))) for _ in range(60)]
    return [None, "", " \n ", LONG, made[0], made[0], made[1] + " x", *made, "It's 12½ ÇA va? <|endoftext|> 日本語", "A b\tC\x0bd"]


def words_of(t):
    return [w for w in (t or "").encode().lower().split()]


def test_tokens_match_the_library(spark, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokens.default_tokenizer())
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 2048)
    assert tokens.count_tokens(docs_of(spark, [])).count() == 0


def test_simhash_brute_force(spark, texts):
    def plain(t):
        w = words_of(t)
        s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [plain(t) for t in texts]
    root = list(range(len(texts)))
    for _ in root:
        for i in root[:]:
            for j in range(len(texts)):
                if bin(fps[i] ^ fps[j]).count("1") <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs_of(spark, texts), shingle=4).collect()}
    assert got == {i: (fps[i], root[i]) for i in range(len(texts))}
    kept = simhash.one_of_each(docs_of(spark, texts).union(docs_of(spark, texts)), shingle=4)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_hot_cells_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 8)
    r = random.Random(3)
    base = [r.getrandbits(63) for _ in range(3)]
    fps = sorted({b ^ sum(1 << i for i in r.sample(range(63), r.randint(0, 5))) for b in base for _ in range(40)})
    want = {f: f for f in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if bin(a ^ b).count("1") <= 4 and want[a] != want[b]:
                    want[a] = want[b] = min(want[a], want[b])
    links = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), 4)
    roots = {x.node: x.root for x in simhash.components(links).collect()}
    classes = lambda m: sorted(sorted(v) for v in _groups(m).values())
    assert classes({f: roots.get(f, f) for f in fps}) == classes(want)


def _groups(m):
    out = defaultdict(list)
    for k, v in m.items():
        out[v].append(k)
    return out


def test_packing(spark, texts):
    rows = packing.pack(docs_of(spark, texts), capacity=256).collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    per = defaultdict(list)
    for r in rows:
        per[r.doc_id].append((r.piece, r.start, r.length))
    assert set(per) == set(range(len(texts)))
    assert all(p == i and s == 256 * i for parts in per.values() for i, (p, s, _) in enumerate(sorted(parts)))
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(tokens.default_tokenizer()).encode(texts[6], add_special_tokens=False).ids[:256]
    whole = b"".join(x.to_bytes(4, "little") for x in [*ids, 0][:256])
    assert next(r for r in rows if r.doc_id == 6 and r.piece == 0).ids_crc32 == zlib.crc32(whole)
    assert packing.pack(docs_of(spark, [])).count() == 0


def test_plan_is_close_to_the_bound():
    r = random.Random(1)
    counts = Counter(min(2048, int(r.expovariate(1 / 500)) + 1) for _ in range(20_000))
    used = Counter()
    placed = Counter()
    table = sorted(packing.plan(counts, 2048))
    for i, (length, rank, seq, _) in enumerate(table):
        nxt = table[i + 1][1] if i + 1 < len(table) and table[i + 1][0] == length else counts[length]
        for k in range(nxt - rank):
            used[seq + k] += length
        placed[length] += nxt - rank
    assert placed == counts and max(used.values()) <= 2048
    assert len(used) <= 1.01 * sum(k * v for k, v in counts.items()) / 2048 + 1


def test_mix_meets_targets(spark, texts):
    r = random.Random(2)
    many = [" ".join(["w"] * r.randint(1, 60)) for _ in range(3000)]
    sources = [r.choice(["a", "a", "a", "b", None]) for _ in many]
    rows = mixing.mix(docs_of(spark, many, sources=sources)).collect()
    taken, target = Counter(), {}
    for x in rows:
        assert x.size == len(many[x.doc_id].split()) and 0 <= x.taken <= 3 * x.size
        taken[sources[x.doc_id]] += x.taken
        target[sources[x.doc_id]] = x.target
    assert all(abs(taken[s] - t) <= 0.01 * t for s, t in target.items())
    again = mixing.mix(docs_of(spark, many, sources=sources).repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert mixing.mix(docs_of(spark, texts)).count() == len(texts)
    assert mixing.mix(docs_of(spark, [])).count() == 0


def test_media_round_trip(spark, texts, tmp_path):
    rows = media.media_columns(docs_of(spark, texts), folder=f"file://{tmp_path}").collect()
    import hashlib

    for r in rows:
        payload = media.payload_of(texts[r.doc_id])
        assert len(payload) % 64 == 0 and payload.rstrip(b"\0") == (texts[r.doc_id] or "").encode()
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        mean = sum(payload) / len(payload)
        std = (sum((x - mean) ** 2 for x in payload) / len(payload)) ** 0.5
        assert (r.width, r.height, r.payload_bytes, r.media_bytes) == (64, len(payload) // 64, len(payload), r.length)
        assert r.feature == f"64x{len(payload) // 64}x8 mean={mean:.4f} std={std:.4f} values={len(set(payload))}"
        with tarfile.open(r.shard.removeprefix("file://")) as tar:
            assert media.from_png(tar.extractfile(f"{r.digest}.png").read()) == payload
    assert len({r.media_sha256 for r in rows if r.doc_id in (0, 1)}) == 1
    assert media.media_columns(docs_of(spark, []), folder=f"file://{tmp_path}").count() == 0


def test_quality_brute_force(spark, texts):
    more = texts + ["a b c d e f g h " * 6, "x\nx\n\ny . \nx", "### a | b | c\n" * 5, "one two three four five six seven eight nine\n" * 4]
    got = {r.doc_id: r.quality for r in quality.rate(docs_of(spark, more)).collect()}
    for i, t in enumerate(more):
        w = words_of(t)
        raw = (t or "").encode().split()
        where = defaultdict(list)
        for j in range(len(raw) - 7):
            where[tuple(raw[j : j + 8])].append(j)
        covered = {j + k for v in where.values() if len(v) > 1 for j in v for k in range(8)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        q = got[i]
        assert (q.n_words, q.n_repeat_words, q.n_dup_lines) == (len(w), len(covered), len(lines) - len(set(lines))), i
        assert q.word_chars == sum(len(x.decode()) for x in raw)
        assert q.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
    assert quality.passing(docs_of(spark, more)).columns == docs_of(spark, []).columns
    assert quality.rate(docs_of(spark, [])).count() == 0


def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    got = langid.identify(d.filter(fold == 1), d.filter(fold != 1)).join(d.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    odd = langid.identify(docs_of(spark, [None, "", "123 ###", "the and"]), docs_of(spark, ["the and of", None])).collect()
    assert [r.lang_pred for r in sorted(odd, key=lambda r: r.doc_id)] == ["und", "und", "und", "en"]
    assert langid.identify(docs_of(spark, ["the"]), docs_of(spark, [])).first().lang_pred == "und"


def test_language_filters_match_plain_sets(spark, monkeypatch):
    """The masks against trigram sets in dictionaries, with more languages than a word of bits and than a task holds; ties, repeats, nulls."""
    monkeypatch.setattr(langid, "HELD", 5)
    r = random.Random(8)
    made = [(f"l{n:02d}", " ".join("".join(r.choice("abcdeé") for _ in range(5)) for _ in range(30))) for n in range(70)]
    made += [made[0], ("zz", made[1][1]), (None, "abc"), ("l03", None)]
    rows = docs_of(spark, [t for _, t in made], [x for x, _ in made])
    counts = defaultdict(Counter)
    for x, t in made:
        if x and t:
            counts[x].update(langid.trigrams(t).tolist())
    share = {x: {g: n / sum(c.values()) for g, n in c.items()} for x, c in counts.items()}
    most = Counter()
    for c in share.values():
        for g, s in c.items():
            most[g] = max(most[g], s)
    languages = sorted(share)
    want = langid.np.zeros((2, langid.SLOTS), dtype=langid.np.uint64)
    for i, x in enumerate(languages):
        for g, s in share[x].items():
            if s >= langid.KEEP * most[g]:
                for at in langid.slots_of(langid.np.array([g])):
                    want[i // 64, at[0]] |= langid.np.uint64(1 << i % 64)
    got = langid.learn(rows)
    assert got.languages == languages and (got.masks == want).all()
    again = langid.identify(rows, rows).collect()
    assert len(again) == len(made) and {x.lang_pred for x in again if x.doc_id in (1, 71)} == {"l01"}  # a tie: the first by code point
    rare = docs_of(spark, ["the and of"] * 2000 + ["le la les"], ["en"] * 2000 + ["fr"])
    assert langid.learn(rare).languages == ["en", "fr"]


def test_toxicity_held_out(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = toxicity.fit(d, labels.filter(fold != 0))
    got = toxicity.score_toxicity(d.filter(fold == 0), model).join(labels, "doc_id").collect()
    hit = sum(r.predicted and r.toxic for r in got)
    assert hit >= 0.7 * sum(r.toxic for r in got) and sum(r.predicted and not r.toxic for r in got) <= 0.01 * len(got)
    none = toxicity.fit(docs_of(spark, ["a"]), labels.filter("false"))
    assert [r.score for r in toxicity.score_toxicity(docs_of(spark, [None, "", LONG]), none).collect()] == [0.5] * 3


def test_ftrl_matches_a_plain_version():
    r = random.Random(6)
    rows = [(sorted(r.sample(range(30), r.randint(0, 12))), r.randint(0, 1)) for _ in range(60)]
    alpha, beta, l1, l2, bias = 2.0, 1.0, 0.3, 1.0, toxicity.BUCKETS
    seen = Counter(f for own, _ in rows for f in own)
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        cost = 0 if i == bias else l1
        return 0.0 if abs(z[i]) <= cost else -(z[i] - math.copysign(cost, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(3):
        for own, y in rows:
            own = [f for f in own if seen[f] >= 2] + [bias]
            w = {i: weight(i) for i in own}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in own:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    got = toxicity.ftrl([(toxicity.np.array(own, dtype=int), y) for own, y in rows], alpha, beta, l1, l2, passes=3, least=2)
    want = {i: weight(i) for i in range(30) if weight(i)}
    assert dict(zip(got.at.tolist(), got.weights.tolist())).keys() == want.keys()
    assert all(abs(x - want[i]) < 1e-5 for i, x in zip(got.at.tolist(), got.weights.tolist())) and abs(got.bias - weight(bias)) < 1e-9


def test_toxicity_edges(spark, monkeypatch):
    """Repeated and null labels and keys, a long text, no documents, and a sample cut by its bytes."""
    texts = ["good day to you"] * 30 + ["vile awful words"] * 30 + [LONG]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i >= 30)) for i in range(60)] + [(0, 0), (0, None), (None, 1), (35, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs.union(docs.limit(5)), labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert all(got[i].predicted == int(i >= 30) for i in range(60)) and 0 <= got[60].score <= 1
    assert toxicity.score_toxicity(docs_of(spark, []), model).count() == 0
    assert toxicity.fit(docs_of(spark, []), labels).bias == 0.0
    monkeypatch.setattr(toxicity, "MAX_BYTES", 400)
    assert abs(toxicity.fit(docs, labels).bias) < 36


def test_url_rules(spark):
    cases = {
        "http://A.Example.com/en/71?q": ("a.example.com", "/en/71", "example.com/en/7", "allow"),
        "https://x.com/en/7": ("x.com", "/en/7", "com/en/", "block"),
        "http://example.net/de/8": ("example.net", "/de/8", "example.net/de/8", "block"),
        "http://notexample.net/de/8": ("notexample.net", "/de/8", "net/de/", "allow"),
        "http://b.org#x/es/": ("b.org", "", None, None),
        "no scheme": ("", "", None, None),
        "x?u=http://z.net/de/1": ("z.net", "/de/1", "net/de/", "allow"),
        None: ("", "", None, None),
    }
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(cases)], "page_id long, url string, host string")
    got = {r.page_id: r for r in urls.filter_urls(pages, URL_RULES).collect()}
    for i, (host, path, rule, verdict) in enumerate(cases.values()):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert urls.filter_urls(pages.filter("false"), URL_RULES).count() == 0


def test_main_text(spark):
    page = '<html><head><title>t</title><script>a("</p>")</script></head><body><nav><a>m</a></nav><div class="ad">buy</div><article><header><h1>A &amp;  B</h1></header><p>x <b>y</b>\n z<br><p>w<aside>no</aside><div class="comments"><p>hi</div></article><footer>f</footer></body>'
    assert html.main_text(page) == "A & B\nx y z\nw"
    assert [html.main_text(x) for x in (None, "", "plain &lt;", "<p>a<p>b", "<div", "<a>l</a> t")] == ["", "", "plain <", "a\nb", "<div", "l t"]
    deep = {"<div>" * 5000 + "x": "x", "<b>" * 5000 + "y</i>" * 3: "yyy", "<ul><li>" * 3000 + "z": "z"}
    assert [html.main_text(x) for x in deep] == list(deep.values()) and all(html.page_hashes(x) for x in deep)
    assert html.main_text("<p class=it's>a</p><p title=\"1>2\">b <a href='u'v'>c</a>") == "a\nb c"  # quotes open a value only after =
    row = lambda i, host: (i, f"http://{host}/{i}", f"<body><div><span>Site {host}</span></div><div><p>Story {i} of {host}</p></div></body>", "x")
    made = [row(i, "a.b") for i in range(8)] + [(99, None, None, "x")]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(made, "page_id long, url string, html string, text string")).collect()}
    assert got[3].text == "Story 3 of a.b" and got[3].n_chars == 14 and (got[99].text, got[99].n_chars) == ("", 0)
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_quality_rules_match_their_sql(spark):
    import duckdb

    from ledgerlens.llm import queries

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL["op8_quality_rules"])
    got = queries.op8_quality_rules(spark, "/root/testdata/sf0.001")
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("group", [1024, 64])
def test_rare_languages_are_learned_and_found(spark, monkeypatch, group):
    """Of 200 languages with alphabets of their own most have a single row among thousands; once in groups of 64."""
    monkeypatch.setattr(langid, "GROUP", group)
    r = random.Random(3)
    alphabet = lambda k: [chr(0x4E00 + 4 * k + i) for i in range(4)]
    said = lambda k: " ".join("".join(r.choices(alphabet(k), k=4)) for _ in range(60))
    rows = [(i, said(0), "l000") for i in range(3000)] + [(5000 + k, said(k), f"l{k:03d}") for k in range(1, 200)]
    filters = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(k, said(k)) for k in range(0, 200, 7)] + [(999, None)], "k long, t string")
    got = {x.k: x.p.lang_pred for x in asked.select("k", langid.predictor(asked, filters)("t").alias("p")).collect()}
    assert got.pop(999) == "und" and sum(got[k] == f"l{k:03d}" for k in got) >= 0.95 * len(got)
