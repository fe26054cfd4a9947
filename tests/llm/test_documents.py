"""Extraction, media and secrets."""

import hashlib
import io
import math
import random
import re
import string
import time
import wave
import zlib

import pytest

from foliospark.llm import extraction, media, secrets, tokens


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad">Buy</div><header>Site</header><div id="cookie-notice">We use cookies</div>
<article><h1>Head &amp; line</h1><p><b>First  par&eacute;\n part<br>goes on<p>Second.</p><aside>Side</aside><ul><li>one<li>two</ul><form>Name <input></form></article>
<section class="comments"><p>Nice article, I really liked this very long comment text that goes on</p></section><footer>&copy; foot</footer></body>"""


def test_main_text():
    assert extraction.main_text(PAGE) == "Head & line First paré part goes on Second. one two"
    plain = "<html><body><div id='menu'>x</div><div><p>" + "body words " * 30 + "</p><p>short.</p></div><div><a>1</a><a>2</a></div></body></html>"
    assert extraction.main_text(plain) == ("body words " * 30).strip() + " short."
    assert extraction.main_text(None) == extraction.main_text("") == extraction.main_text("<p></p>") == ""
    assert extraction.main_text("just text &lt;b&gt;") == "just text <b>"


def test_extract_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (1, "u", PAGE, "x"), (None, "v", "<p>a", "x")], "page_id long, url string, html string, text string")
    rows = sorted((tuple(r) for r in extraction.extract(df).collect()), key=repr)
    assert len(rows) == 4 and all(r[3] == len(r[2]) for r in rows)
    assert extraction.extract(df.where("1 = 0")).count() == 0


def test_media_round_trip(spark, docs, empty):
    for raw in (b"", b"a", b"x" * 63, b"x" * 64, bytes(range(256)), "漢字".encode()):
        payload = media.payload_of(raw)
        assert len(payload) % 64 == 0 and payload and payload.rstrip(b"\0") == raw.rstrip(b"\0") and len(payload) - len(raw) <= 64
        stored = media.to_media(payload)
        assert media.from_media(stored) == payload
        with wave.open(io.BytesIO(stored)) as w:
            assert w.readframes(w.getnframes()) == payload and (w.getnchannels(), w.getsampwidth()) == (1, 1)
    rows = media.media_columns(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == docs.count() and media.media_columns(empty).count() == 0
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = media.payload_of(raw)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_sha256"] == hashlib.sha256(media.to_media(payload)).hexdigest() and r["caption"] == f"{len(raw)} bytes"


def test_sequences_keep_order_and_captions():
    items = media.sequence_of('<p>a b</p><figure><img src="sha256:ff" alt="x"><figcaption>the <b>cap</b></figcaption></figure>tail<img src="sha256:aa" alt="alt"><img src="/local.png"><script>no</script>')
    assert [(i["position"], i["kind"], i["text"] or i["digest"], i["caption"]) for i in items] == [(0, "text", "a b", None), (1, "media", "ff", "the cap"), (2, "text", "tail", None), (3, "media", "aa", "alt")]
    assert media.sequence_of(None) == []


@pytest.mark.parametrize("text, want", [
    ("password=abc12 token: abcdef", "assign:15:28"), ("secret: token = abcdefgh", ""), ('API_KEY = "abc/DEF=1" x', "assign:0:20"), ("AKIA" + "A1" * 8 + " AKIASHORT", "access:0:20"), ("x deadbeef" + "0" * 16 + " deadbeef", "hex:2:26"),
    ("pässwort Größe token=abcdefg", "assign:15:28"), ("key Zk9Qx7Lw2Vb8Nt4Rj6Hs1Pd3 end", "random:4:28"), ("id 123e4567-e89b-12d3-a456-426614174000 and 2024-01-01T00-00-00", ""), ("some_long_identifier_name_12 ThisIsAClassName2", ""), ("", ""),
])
def test_spans(text, want):
    found = secrets.spans(text, tokens.encoder(tokens.vocabulary()), ratio=2.1, known=frozenset())
    assert secrets.joined(found) == want


def test_known_strings_are_left_out():
    text = "key Zk9Qx7Lw2Vb8Nt4Rj6Hs1Pd3 end"
    assert not secrets.spans(text, tokens.encoder(tokens.vocabulary()), ratio=2.1, known=frozenset(["Zk9Qx7Lw2Vb8Nt4Rj6Hs1Pd3"]))


def test_secret_rows(docs, empty):
    rows = {r["doc_id"]: r for r in secrets.digest_rows(docs).collect()}
    assert secrets.digest_rows(docs).count() == docs.count() and secrets.digest_rows(empty).count() == 0
    r = rows[11]
    assert (r["n_assign"], r["n_access"], r["n_hex"]) == (1, 1, 1)
    assert r["base_sha256"] == hashlib.sha256(r["spans"].encode()).hexdigest()
    assert rows[3]["spans"] == "" and rows[3]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    out = {r["doc_id"]: r for r in secrets.redacted(docs).collect()}
    assert out[11]["text"] == "[SECRET]\" and [SECRET]" and out[11]["n_chars"] == len(out[11]["text"]) and out[3]["text"] is None
    assert not re.search("f4a8|AKIA", out[11]["text"])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(out[i]["text"] == texts[i] and out[i]["n_chars"] == r["n_chars"] for i, r in out.items() if i != 11)


def test_random_strings_of_every_shape_are_found():
    rnd, encode = random.Random(3), tokens.encoder(tokens.vocabulary())

    def share(letters, size):
        drawn = ["".join(rnd.choices(letters, k=size)) for _ in range(300)]
        return sum(secrets.joined(secrets.spans(f"a {x} b", encode, ratio=2.1, known=frozenset())) == f"random:2:{2 + size}" for x in drawn) / 300

    lower, upper = string.ascii_lowercase, string.ascii_uppercase
    for letters, size in ((lower, 24), (lower + upper, 24), (lower + upper + "_", 32), (lower + upper + string.digits, 16), ("0123456789ABCDEF", 32), ("0123456789ABCDEF", 40)):
        assert share(letters, size) > 0.95, (letters, size)
    for name in ("to_be_or_not_to_be_that_is", "internationalization", "ThisIsAClassName2", "path/to/some/other/file", "Geschwindigkeitsbegrenzung", "----------------------"):
        assert not secrets.spans(name, encode, ratio=2.1, known=frozenset()), name


def test_random_string_beyond_a_base_span():
    run = "deadbeef" * 3
    text = f"x Zk9Qx7Lw2Vb8Nt4Rj6Hs1Pd3/{run} y"
    found = secrets.spans(text, tokens.encoder(tokens.vocabulary()), ratio=2.1, known=frozenset())
    assert secrets.joined(found) == "random:2:51,hex:27:51"


def slow_spans(text, encode, ratio):
    """Every candidate against every base span, and base spans by plain search of each start."""
    found = []
    at = 0
    while m := re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""").search(text, at):
        found += [("assign", m.start(), m.end())] if len(m[1]) >= 6 else []
        at = m.end()
    for kind, letters, lead, least in (("access", string.ascii_uppercase + string.digits, "AKIA", 20), ("hex", "0123456789abcdef", "", 24)):
        at = 0
        while at < len(text):
            end = at + len(lead)
            while text.startswith(lead, at) and end < len(text) and text[end] in letters:
                end += 1
            if text.startswith(lead, at) and end > at + len(lead):
                found += [(kind, at, end)] if end - at >= least else []
                at = end
            else:
                at += 1
    base = list(found)
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", text):
        inside = any(a <= m.start() and m.end() <= b for _, a, b in base)
        if not inside and not secrets.IDENTIFIER.fullmatch(m[0]) and secrets.is_random(m[0], encode, ratio):
            found.append(("random", m.start(), m.end()))
    return sorted(found, key=lambda x: (x[1], ("assign", "access", "hex", "random").index(x[0]), x[2]))


def test_spans_against_brute_force():
    rnd, encode = random.Random(12), tokens.encoder(tokens.vocabulary())
    hexes = "0123456789abcdef"
    for _ in range(300):
        parts = []
        for _ in range(rnd.randrange(8)):
            parts.append(rnd.choice([
                lambda: rnd.choice(["password", "Token", "API_KEY", "secret"]) + rnd.choice(["=", " : ", '"= "']) + "".join(rnd.choices(string.ascii_letters + "/=.-", k=rnd.randrange(1, 30))),
                lambda: "AKIA" + "".join(rnd.choices(string.ascii_uppercase + string.digits, k=rnd.randrange(1, 30))), lambda: "".join(rnd.choices(hexes, k=rnd.randrange(10, 60))),
                lambda: "".join(rnd.choices(string.ascii_letters + string.digits + "_/", k=rnd.randrange(5, 50))), lambda: rnd.choice(["plain words", "päss wörter", "some_long_identifier_name", "2024-01-01T00-00"]),
            ])())
            parts.append(rnd.choice([" ", "", "/", "\n", "é"]))
        text = "".join(parts)
        assert secrets.spans(text, encode, ratio=2.1, known=frozenset()) == slow_spans(text, encode, 2.1), text


def test_many_spans_take_linear_time():
    encode = tokens.encoder(tokens.vocabulary())
    text = "token=Zk9Qx7Lw2Vb8 Zk9Qx7Lw2Vb8Nt4Rj6Hs1Pd3 " * 24_000  # about a megabyte
    start = time.process_time()
    found = secrets.spans(text, encode, ratio=2.1, known=frozenset())
    assert len(found) == 48_000 and time.process_time() - start < 5


def slow_main_text(html):
    """The same rules from the definition: direct sums, and each line's path to the root walked for every question."""
    lines, parents, names = extraction.lines_of(html)
    if not lines:
        return ""

    def path(c):
        return [c, *path(parents[c])] if c >= 0 else []

    raw = [math.log(len(text) / (1 + tags) + 1) for text, tags, _, _ in lines]
    weights = [math.exp(-0.5 * d * d) for d in range(4)]
    ratio = []
    for i in range(len(raw)):
        near = [(weights[abs(i - j)], raw[j]) for j in range(len(raw)) if abs(i - j) <= 3]
        ratio.append(sum(w * x for w, x in near) / sum(w for w, _ in near))
    low, high = min(ratio), max(ratio)
    cut, spread = low, high - low
    if high - low >= math.log(2):
        for _ in range(50):
            parts = [x for x in ratio if x < (low + high) / 2], [x for x in ratio if x >= (low + high) / 2]
            low, high = (sum(p) / len(p) for p in parts)
        cut, spread = (low + high) / 2, high - low
    most = max(ratio) - min(ratio)
    shift = {1: min(most, extraction.FOR * spread), 0: 0.0, -1: -min(most, extraction.AGAINST * spread)}
    content = [r + shift[sign] >= cut for r, (_, _, _, sign) in zip(ratio, lines)]

    def chars(c, only_content, only_own=False):
        inside = [i for i, x in enumerate(lines) if (x[2] == c if only_own else c in path(x[2]))]
        return sum(len(lines[i][0]) for i in inside if content[i] or not only_content and lines[i][3] >= 0)

    whole = max((len(path(c)), c) for c in range(len(parents)) if chars(c, True) >= 0.9 * chars(0, True))[1] if any(content) else 0
    articles = [c for c, name in enumerate(names) if name in ("article", "main") and 2 * chars(c, True) >= chars(c, False) > 0]
    regions = set(articles)
    if 2 * sum(chars(c, True) for c in articles) < chars(0, True) or not articles:
        regions.add(whole)
    kept = []
    for (text, _, c, sign), good in zip(lines, content):
        filled = chars(c, True, True) and 2 * chars(c, True, True) >= chars(c, False, True) and chars(c, True, True) >= extraction.FILLED * chars(0, True)
        if (good or sign >= 0) and (regions & set(path(c)) or filled):
            kept.append(text)
    return " ".join(kept)


def test_main_text_against_brute_force():
    rnd = random.Random(6)
    words = "river stone lantern window garden winter letter morning".split()

    def inline():
        text = " ".join(rnd.choices(words, k=rnd.choice([1, 3, 40])))
        return rnd.choice(["{}", "<a href='/'>{}</a>", "<b>{}</b> and", "{}<br>"]).format(text)

    def block(depth):
        tag = rnd.choice(["p", "div", "div", "section", "li", "nav", "aside", "article", "td", "form"])
        mark = rnd.choice(["", "", "", " class='sidebar'", " class='story'", " id='comments'"])
        inner = inline() if depth == 0 or rnd.random() < 0.4 else "".join(block(depth - 1) for _ in range(rnd.randrange(1, 4)))
        return f"<{tag}{mark}>{inner}" + (f"</{tag}>" if rnd.random() < 0.9 else "")

    seen = set()
    for _ in range(400):
        html = "".join(block(3) for _ in range(rnd.randrange(1, 4)))
        assert extraction.main_text(html) == slow_main_text(html), html
        seen.add(extraction.main_text(html))
    assert len(seen) > 300


STORY = "<div class=x>" + "".join(f"<p>{'words of a story that goes on for a good while ' * n}</p>" for n in (5, 7, 1, 6)) + "</div>"
LINKS = "<div>" + "".join(f"<p><a href=/{i}>go {i}</a> <a href=/x>x</a></p>" for i in range(12)) + "</div>"


def test_the_threshold_decides(monkeypatch):
    """Pages without any markup that names their parts, and one with it: without the threshold the menus stay."""
    story = " ".join(extraction.main_text(STORY).split())
    pages = [LINKS + STORY, STORY + LINKS, LINKS + STORY + LINKS, f"<table><tr><td>{LINKS}</td><td>{STORY}</td></tr></table>", PAGE]
    before = [extraction.main_text(p) for p in pages]
    assert all(x == story for x in before[:4])
    monkeypatch.setattr(extraction, "clusters", lambda values: (-1e9, 0.0))
    after = [extraction.main_text(p) for p in pages]
    assert all(a != b for a, b in zip(before, after)) and all("go 3" in x for x in after[:4])


def page_like_the_tables(seed, names=True):
    """A menu, an advert, an article and a footer, as the pages of the test tables have them; without names every part is a div."""
    r = random.Random(seed)
    words = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) for _ in range(n))
    nav, article, footer, ad = ("nav", "article", "footer", ' class="ad"') if names else ("div", "div", "div", "")
    menu = "".join(f'<li><a href="/{i}">{words(1)}</a></li>' for i in range(60))
    body = f"<h1>{words(9)}</h1>" + "".join(f"<p>{words(r.randrange(30, 90))}.</p>" for _ in range(6)) + "<p>Short.</p>"
    page = f"<html><body><{nav}><ul>{menu}</ul></{nav}><div{ad}>{words(9)}</div><{article}>{body}</{article}><{footer}>&copy; {words(12)}</{footer}></body></html>"
    return page, " ".join(re.sub("<[^>]+>", " ", body).split())


def test_ratio_and_clusters_decide_on_pages_like_the_tables(monkeypatch):
    """With names or without the article is found; with the ratio made constant it isn't, though the lists are as before."""
    for names in (True, False):
        pages = [page_like_the_tables(i, names) for i in range(20)]
        assert all(extraction.main_text(p) == want for p, want in pages)
        with monkeypatch.context() as patch:
            patch.setattr(extraction, "smoothed", lambda values, sigma: values * 0)
            assert all(extraction.main_text(p) != want for p, want in pages)


def test_dense_text_outweighs_what_its_markup_says():
    """A story that its site calls a sidebar stays beside thin text, and a short notice goes."""
    story, notice = "a long paragraph of the story goes on and on " * 120, "read our notice"
    thin = "".join(f"<p><a href='/{i}'>go</a> <a href='/x'>on</a></p>" for i in range(12))
    plain = "plain words of a middling line " * 5
    page = f"<body><div>{thin}</div><aside><p>{notice}</p></aside><div>{f'<p>{plain}</p>' * 200}</div><aside>{f'<p>{story}</p>' * 3}</aside></body>"
    got = extraction.main_text(page)
    assert got.count(story.strip()) >= 1 and got.count(plain.strip()) == 200 and notice not in got


def test_deep_pages_are_read_in_linear_time():
    def seconds(page):
        start = time.process_time()
        extraction.main_text(page)
        return time.process_time() - start

    for piece in ("<div class='x'>a", "<p>a<b>", "<div><b></u></p>", "<li><i>a"):
        few, many = seconds(piece * 4_000), seconds(piece * 32_000)
        assert many < 8 * max(few, 0.05) * 3, piece
    for page in ("<div>" * 30_000 + "</section>" * 30_000, "<div>" + "<b>" * 30_000 + "<p></p></i>" * 30_000, "<main>" * 20_000 + "word"):
        assert seconds(page) < 8


def test_content_beside_the_largest_container_stays():
    long = "body words of the story " * 30
    part = "a last part that goes on for a while " * 3
    page = f"<body><div><a>1</a><a>2</a></div><div><p>{long}</p><p>{long}</p></div><div><p>{part}</p></div></body>"
    assert part.strip() in extraction.main_text(page) and long.strip() in extraction.main_text(page)
    two = f"<body><p>{part}</p><article><p>{long}</p><p>short.</p></article><article><p>{part} second</p><p>end.</p></article></body>"
    got = extraction.main_text(two)
    assert got.count(part.strip()) == 2 and got.endswith("second end.") and "short." in got


@pytest.mark.parametrize("start, end", [('<div class="page has-sidebar">', "</div>"), ('<div id="content" class="no-sidebar">', "</div>"), ('<div class="post comments-open">', "</div>"), ("<form>", "</form>")])
def test_marked_wrappers_of_the_page_are_read(start, end):
    text = "words of the article " * 20
    inner = f'<p>{text}</p><div class="sidebar">Side</div><form>Name</form>'
    assert extraction.main_text(f"<body>{start}{inner}{end}</body>") == text.strip()
    few = f"<body>{start}<article><p>Few words.</p></article>{end}<div><p>{text}</p></div></body>"
    assert "Few words." in extraction.main_text(few)
    assert "Buy" not in extraction.main_text(f'<p>{text} <span class="ad">Buy</span> on</p>')
