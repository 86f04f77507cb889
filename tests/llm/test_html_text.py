import random

import pytest

from locusframe.llm.html_text import Page, _chosen, _states, extract_text, main_text

LONG = "This is a paragraph of the article that goes on for a while, so that it has text enough, twice or more."
NAV = "<ul>" + "".join(f'<li><a href="/{k}">Section number {k}</a></li>' for k in range(12)) + "</ul>"


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("   \n", ""),
        ("only words", "only words"),
        ("<p>one<p>two", "one two"),
        ("<article><h1>T &amp; U</h1><p>a<b>b</b>c &copy 5 &lt;x&gt; &#233;&#xe9;</article>", "T & U abc © 5 <x> éé"),
        ("<article>x<!-- <p>no</p> -->y<!--> z <script>if (a < b) '</p>'</script>&nbsp; w</article>", "xy z w"),
        ("<article><p>kept</p><div class='comment-list'><p>Reader: " + LONG * 9 + "</p></div></article>", "kept"),
        ("<body class='no-sidebar has-menu'><div id=wrap><p>kept words</p></div></body>", "kept words"),
        ("<div class='ad'>buy</div><p>kept</p><form><label>mail</label><input><button>go</button></form>", "kept"),
        ("<article><header><h2>Head</h2><span>by me</span></header><p>kept</p><footer>tags</footer></article>", "Head kept"),
        ("<header><h1>Site</h1></header><main><h1>Title</h1><div><p>kept</p><p>kept too</p></div></main>", "Title kept kept too"),
        ("<article><p>an unclosed <a href='x>y'>link</a> <i>here<p>next</article><p>after", "an unclosed link here next"),
        ("<article><table><tr><td>a<td>b<tr><td>c</table><ul><li>d<li>e</ul></article>", "a b c d e"),
        ("<article><p>x</p><p hidden>no</p><p style='display: none'>no</p><div role=dialog>no</div></article>", "x"),
        ("<article>cut <p class='a", "cut"),
        ("<article>cut<script>never closed <p>text", "cut"),
        ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"),
        ("<article>a</p></div></b>b<br>c</article>", "a b c"),
        ("<title>t</title><style>p{}</style>a<wbr>b", "ab"),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


def test_density_tells_text_from_links():
    """No element says what it is."""
    body = "".join(f"<p>{k} {LONG}</p>" for k in range(6))
    page = f"<body><div>{NAV}</div><div><h1>A title of this page</h1><div>{body}</div></div><div>{NAV}</div></body>"
    want = " ".join(["A title of this page", *[f"{k} {LONG}" for k in range(6)]])
    assert main_text(page) == want
    # In two pieces, with links between them.
    page = f"<body><div>{NAV}</div><section>{body}</section><div>{NAV}</div><section>{body}</section></body>"
    assert main_text(page).count(LONG) == 12 and "Section" not in main_text(page)


def test_sums_against_a_recursive_version():
    """The chosen element has the largest sum of densities of all, by the formula written out."""
    import math

    rnd = random.Random(5)

    def tree(depth):
        inner = "".join(tree(depth - 1) for _ in range(rnd.randint(0, 3))) if depth else ""
        words = " ".join("w" * rnd.randint(1, 9) for _ in range(rnd.randint(0, 12)))
        tag = rnd.choice(["div", "section", "p" if not depth else "div", "a" if not depth else "div"])
        return f"<{tag}>{words}{inner}</{tag}>"

    for _ in range(60):
        page = Page(f"<body>{tree(4)}</body>")
        chosen = _chosen(page, _states(page, True))
        n = len(page.name)
        kids = [[c for c in range(n) if page.parent[c] == k] for k in range(n)]
        linked = lambda k: k > 0 and (page.name[k] == "a" or linked(page.parent[k]))
        own = [sum(len(" ".join(t.split())) for j, _, t in page.texts if j == k) for k in range(n)]

        def count(k):
            c, lc, t, lt = own[k], own[k] if linked(k) else 0, 1, int(linked(k))
            for j in kids[k]:
                c, lc, t, lt = (a + b for a, b in zip((c, lc, t, lt), count(j)))
            return c, lc, t, lt

        share = count(0)[1] / max(count(0)[0], 1)

        def density(c, lc, t, lt):
            if not c:
                return 0.0
            return c / t * math.log(c * t / (max(lc, 1) * max(lt, 1))) / math.log(math.log(c * max(lc, 1) / max(c - max(lc, 1), 1) + share * c + math.e))

        sums = [sum(density(*count(j)) for j in kids[k]) + density(own[k], own[k] if linked(k) else 0, 1, int(linked(k))) for k in range(n)]
        if count(0)[0]:
            best = max(range(n), key=lambda k: (round(sums[k], 9) if count(k)[0] else -9e9, -k))
            assert chosen[best]


def test_deep_and_broken_pages():
    assert main_text("<div>" * 50_000 + "deep") == "deep"
    assert main_text("<b>" * 20_000 + "x" + "</i>" * 20_000) == "x"
    rnd = random.Random(1)
    bits = ["<", ">", "<p", "<div class=", '"', "'", "=", "a", " ", "</", "<!--", "-->", "<script>", "</script>", "&am", "&#", "<table>", "<td>", "<li>"]
    for _ in range(300):
        main_text("".join(rnd.choice(bits) for _ in range(60)))


def test_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars int, page long"
    rows = [
        (1, "u", "<article>é one</article>", "clash", 5, 6),
        (1, "u", "<article>é one</article>", None, None, None),
        (None, None, "<p>x", None, None, None),
        (2, "v", None, "", 0, 0),
        (3, "w", "<article>" + "<p>word</p>" * 100_000 + "</article>", "", 0, 0),
    ]
    df = spark.createDataFrame(rows, schema)
    got = extract_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted(map(tuple, got.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert found[:3] == [(1, "u", "é one", 5)] * 2 + [(2, "v", "", 0)]
    assert found[3][2:] == (" ".join(["word"] * 100_000), 499_999) and found[4] == (None, None, "x", 1)
    assert extract_text(df.limit(0)).count() == 0
    # Bytes that are no UTF-8.
    odd = df.limit(1).selectExpr("page_id", "url", "unhex('3C703EFF61') AS html")
    assert extract_text(odd).first()["text"] == "�a"
