import random
import re

from conftest import messy

from panelwright.llm import html_extract as h


def page(i, marked=True, extra=""):
    words = [f"word{(i * 7 + j) % 50}" for j in range(40)]
    body = "".join(f"<p>{' '.join(words[j : j + 12])}, and more. So it  goes&amp;on.</p>" for j in range(0, 36, 6))
    open_, shut = ("<article>", "</article>") if marked else ('<div id="x">', "</div>")
    return (
        f"<!DOCTYPE html><html><head><title>t{i}</title><script>var a='</p>';</script></head><body><nav><ul><li><a href='/a'>Home</a></li>"
        f"<li><a href='/b'>News</a></li></ul></nav><div class=\"ad\">Buy now {i}.</div>{open_}<h1>Title {i}</h1>{body}{extra}{shut}"
        f"<aside><p>See also this</p></aside><footer>&copy; site {i} &middot; terms</footer></body></html>"
    )


def text(i):
    words = [f"word{(i * 7 + j) % 50}" for j in range(40)]
    return "\n".join([f"Title {i}", *(f"{' '.join(words[j : j + 12])}, and more. So it goes&on." for j in range(0, 36, 6))])


def test_marked_and_unmarked_pages(spark):
    comments = '<section class="comments"><p>First! I like this a lot.</p><p>me too, really.</p></section>'
    rows = [(i, "u", page(i)) for i in range(60)]
    rows += [(100, "u", page(3, marked=False)), (101, "u", page(4, extra=comments)), (102, None, None), (103, "u", ""), (None, "u", page(5)), (7, "u", page(7))]
    rows += [(104, "u", "<html><body><script>only()</script></body>"), (105, "u", page(6).replace("</body></html>", ""))]
    df = messy(spark, rows, "page_id long, url string, html string")
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in h.extract(df).collect()]
    want = [(i, "u", text(i), len(text(i))) for i in [*range(60), 7]]
    want += [(100, "u", text(3), len(text(3))), (101, "u", text(4), len(text(4))), (102, None, "", 0), (103, "u", "", 0), (None, "u", text(5), len(text(5)))]
    want += [(104, "u", "", 0), (105, "u", text(6), len(text(6)))]
    assert sorted(map(str, got)) == sorted(map(str, want))


def everything(source):
    p = h.Page(source)
    return p.decode(h.Forest([]).likely(p.features()))


def test_reading_of_markup():
    assert everything("<p><b>One<br><p>Two &lt;b&gt; &eacute;</p> loose <i>run</i><div>in</div>tail") == "One\nTwo <b> é\nloose run\nin\ntail"
    assert everything("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == "a\nb\nc\nd"
    assert everything("x<script>if (a<b) '</p>'</SCRIPT >y<!-- <p>no --><style>p{}</style>z<textarea><p>t</textarea>") == "xyz"
    assert everything('<p title="a>b">q</p><p>1 < 2 &amp; 3</p><p>un<!-- closed') == "q\n1 < 2 & 3\nun"
    assert everything("<select><option>no</option></select><button>no</button>yes\xa0 \n there") == "yes there"
    assert everything("") == everything("<html></html>") == ""
    assert everything("<div>" * 3000 + "deep" + "</div>" * 10) == "deep"


def test_silent_elements_without_end_tags():
    assert everything("<p>a</p><select><option>A<option>B</select><p>b</p>") == "a\nb"
    assert everything("<select><optgroup><option>A<optgroup><option>B<option>C</select>after") == "after"
    assert everything("<datalist><option>A<option>B</datalist>after") == "after"
    assert everything("<html><head><meta charset=x><title>t</title><link rel=y><p>text") == "text"
    assert everything("<head><script>s()</script>\n<span>loose</span> run") == "loose run"
    assert everything("<head><title>t</title>words") == "words"
    assert everything("<head><style>s</style></head><body><div>in</div>") == "in"
    assert everything("</option></select>x<button>no<svg><text>no</button>y<object>no</object>z") == "xyz"


def test_labels_below_a_dropped_node_are_dropped():
    import numpy as np

    p = h.Page("<div><p>a</p><p>b</p></div><div><p>c</p></div>")
    likely = {"#page": 0.5, "div": 0.1, "p": 0.6}
    assert p.decode(np.asarray([likely[t] for t in p.tag])) == ""
    assert p.decode(np.asarray([0.5, 0.4, 0.9, 0.9, 0.1, 0.6])) == "a\nb"


def test_empty_table(spark):
    assert h.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


TAG = re.compile(
    r"""<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*>|(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>|(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>)""",
    re.S,
)


def test_tags_are_those_of_the_pattern():
    draw = random.Random(6)
    for _ in range(20_000):
        source = "".join(draw.choice(["<", ">", '"', "'", "a", "b=", " ", "/", "<a ", "</a", "<!", "<!--", "-->", "--!>", "<?"]) for _ in range(draw.randint(0, 25)))
        tags, at, got = h.Tags(source), 0, []
        while found := tags.after(at):
            got.append(found)
            at = found[1]
        want = [(m.start(), m.end(), bool(m[1] or m[4]), (m[2] or m[5] or "").lower(), m[3] if m[2] else m[6] or "") for m in TAG.finditer(source)]
        assert got == want, source


def test_hostile_pages_are_read_in_linear_time():
    import time

    for part in ("<a href='x ", "<a href='x>", "<a \"'>", "<a '\" '>", "<!", "<a <b ", "<p>'", "<!-- ", "&amp", "<a b=\"c' >", "<li><ul>" , "</div>", "</p>", "<tr>", "<script>"):
        began = time.process_time()
        h.Page(part * (200_000 // len(part)))
        h.Page("<div>" * 20_000 + part * 20_000)
        assert time.process_time() - began < 5, part
