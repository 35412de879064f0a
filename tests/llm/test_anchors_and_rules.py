"""Closed syncmers against their definition in plain numbers; rule indexes of thousands against every rule in turn."""

import random

import numpy as np

from loomline.llm import fingerprints as f
from loomline.llm import urls
from loomline.llm.common import mix


def inner(text):
    """Hash of four code points, as plain numbers."""
    total = sum(ord(c) * 0x9E3779B97F4A7C15 * int(f._PLACE[j]) for j, c in enumerate(text)) % 2**64
    return int(mix(np.array([total], np.uint64))[0])


def test_syncmers_are_those_of_the_definition():
    r = random.Random(3)
    texts = ["".join(r.choice("ab é😀\nxyz") for _ in range(n)) for n in (12, 13, 40, 300)] + ["a" * 50]
    for t in texts:
        want = []
        for i in range(len(t) - f.K + 1):
            h = [inner(t[i + j : i + j + f.S]) for j in range(f.K - f.S + 1)]
            if min(h) in (h[0], h[-1]):
                want.append(i)
        h, at = f.anchors(t)
        assert at.tolist() == want
        assert all((h[a] == h[b]) == (t[i : i + f.K] == t[j : j + f.K]) for a, i in enumerate(want) for b, j in enumerate(want))


def test_likeness_follows_shared_passages():
    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(4000)]
    a, b = " ".join(words[:1500]), " ".join(words[2000:3500])
    half = a[: len(a) // 2] + b[len(b) // 2 :]
    near = [f.likeness(f.fingerprint(a), f.fingerprint(x)) for x in (a, half, b)]
    assert near[0] == 1 and 0.1 < near[1] < 0.7 and near[2] < 0.05


def test_thousands_of_rules_are_judged_as_if_each_ran(spark):
    r = random.Random(5)
    names = ["".join(r.choice("abcdefghij") for _ in range(4)) for _ in range(300)]
    host = lambda: ".".join([r.choice(names), *([r.choice(names)] if r.random() < 0.5 else []), r.choice(["com", "net"])])
    path = lambda: r.choice(["", "/", f"/{r.choice(names)}", f"/{r.choice(names)}/{r.choice(names)[:2]}"])
    rules = [urls.Rule(r.choice(["allow", "block"]), host(), path()) for _ in range(3000)] + [urls.Rule("block", "net", "/")]
    known = [x.host for x in rules]
    pages = [(i, f"http://{r.choice(['', 'www.', 'x'])}{r.choice(known) if i % 2 else host()}{path()}{r.choice(['', '?q=1', 'z'])}") for i in range(2000)] + [(None, None), (7, "http://NET/")]
    want = []
    for page, url in pages:
        h, p = urls.split_url(url)
        fits = [(-len(x.host + x.path), i) for i, x in enumerate(rules) if (h == x.host or h.endswith("." + x.host)) and p.startswith(x.path)]
        best = rules[min(fits)[1]] if fits else None
        want.append((page, best and best.name, best.verdict if best else "allow"))
    got = urls.judged(spark.createDataFrame(pages, "page_id long, url string"), rules, []).collect()
    order = lambda x: tuple(map(str, x))
    assert sorted(((g.page_id, g.rule, g.verdict) for g in got), key=order) == sorted(want, key=order)
    assert sum(w[1] is not None for w in want) > 1000


def test_patterns_block_what_they_name_and_leave_the_rest(spark):
    blocked = [
        "http://a.casino.net/", "http://xn--abc.net/x", "http://ads.adserver.net/", "http://win2024now.top/", "http://a-b-c-d.info/", "http://x.net/blog/wp-login.php", "http://x.net/cgi-bin/" + "q" * 90,
        "http://x.net/calendar/2024/7", "http://x.net/tag/a/page/123", "http://x.net/cart/add?id=1", "http://x.net/session/" + "0a" * 12, "http://x.net/setup.exe?v=1", "http://x.net/?a=1&phpsessid=" + "a1" * 8, "http://x.net/p?replytocom=7",
        "http://x.net/go?redirect=https%3A", "http://x.net/s?sort=a&b=1&filter=c",
    ]
    allowed = [
        "http://spamming.net/", "http://a.xnn--x.net/", "http://win2024.topic/", "http://a-b.info/", "http://x.net/wp-loginx", "http://x.net/cgi-bin/a", "http://x.net/calendar/may", "http://x.net/tag/a/page/12", "http://x.net/setup.exe.html",
        "http://x.net/?nophpsessid=" + "a1" * 8, "http://x.net/p#replytocom=7", "http://x.net/?utm_source=feed", "casino.exe", None, "", "http://x.net/" + "a" * 100_000,
    ]
    rows = [(i, u) for i, u in enumerate(blocked + allowed)]
    got = {r.page_id: r.verdict for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string"), []).collect()}
    assert [u for i, u in rows if got[i] != ("block" if i < len(blocked) else "allow")] == []
    assert urls.judged(spark.createDataFrame([], "page_id long, url string")).collect() == []
    assert all(r.tokens() for r in urls.PATTERNS)


def test_prints_of_long_texts_grow_and_compare_as_the_texts():
    r = random.Random(6)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(60_000)]
    long_, other = " ".join(words[:30_000]), " ".join(words[30_000:])
    h, _ = f.anchors(long_)
    kept = f.fingerprint(long_)[0]
    assert kept.tolist() == sorted({x for x in h.tolist() if x <= f._LOW}) and len(kept) > 4 * f.ANCHORS
    for share in (0.1, 0.5, 0.9):
        mixed = long_[: int(share * len(long_))] + other[int(share * len(long_)) :]
        a, b = set(h.tolist()), set(f.anchors(mixed)[0].tolist())
        assert abs(f.likeness(f.fingerprint(long_), f.fingerprint(mixed)) - len(a & b) / len(a | b)) < 0.06
    short = long_[: len(long_) // 10]
    a, b = set(h.tolist()), set(f.anchors(short)[0].tolist())
    assert abs(f.likeness(f.fingerprint(long_), f.fingerprint(short)) - len(a & b) / len(a | b)) < 0.05
