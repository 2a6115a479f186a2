"""HTML into Markdown against hand-made pages and pinned texts."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import markup

PAPER = r"""<!DOCTYPE html><html><head><title>Sample Paper</title></head><body><div class="ltx_titlepage"><h1>Paper Title</h1></div>
<div class="ltx_authors"><span>John Doe</span></div><section><h6 class="ltx_title_abstract">Abstract</h6><p>This is the abstract.</p></section>
<section><h2>Introduction</h2><p>Inline equation: <math alttext="E = mc^2" display="inline">E</math> <a class="ltx_ref" href="#r">[3, 4]</a></p><p>Display equation:</p>
<table class="ltx_eqn_table"><tr class="ltx_eqn_row"><td class="ltx_eqn_cell"><math alttext="\int_{0}^{\infty} e^{-x^2} dx" display="block">integral</math></td></tr></table>
<ul><li><span class="ltx_tag_item">1.</span> First item</li><li><span class="ltx_tag_item">2.</span> Second item</li></ul><div class="ltx_role_footnote">This is a footnote.</div>
<figcaption class="ltx_caption">Figure 1: A figure</figcaption></section><section id="bib"><h2>Bibliography</h2><ul class="ltx_biblist"><li>Reference 1</li></ul></section>
<section id="ltx_bibliography"><h2>References</h2><a class="ltx_ref" href="#ref1">1</a></section><footer>Generated</footer></body></html>"""

ENCYCLOPEDIA = r"""<html><head><title>Sample Article</title></head><body><h1>Sample Article</h1><table class="infobox"><tr><th>Type</th><td>Example</td></tr></table>
<p>Introduction with inline math:<span class="mwe-math-element"><math><annotation encoding="application/x-tex">{\displaystyle E=mc^{2}}</annotation></math></span></p>
<dl><dd><span class="mwe-math-element"><math><annotation encoding="application/x-tex">\int_0^\infty e^{-x} dx = 1</annotation></math></span></dd></dl>
<h2 id="References">References</h2><div class="reflist"><ol><li>Reference 1</li></ol></div></body></html>"""


@pytest.mark.parametrize(("html", "want"), [
    ("", ""), ("<p>a<p>b &amp; c", "a\n\nb & c"), ("a<br>b", "a  \nb"), ("<h2>T <b>x</b></h2>t", "## T **x**\n\nt"), ("<p>x <em> y </em>z</p>", "x *y* z"),
    ('<p><a href="/r">a link</a>, <a href="u" title="q">b</a>, <a>c</a>', '[a link](/r), [b](u "q"), c'), ('<img src="/i.png" alt="im[g">', "![im\\[g](/i.png)"),
    ("<ul><li>a<li>b<ul><li>c<ul><li>d</ul></ul><li>e</ul>", "* a\n* b\n    + c\n        - d\n* e"), ('<ol start="3"><li>x</li><li><p>y</p><p>z</p></li></ol>', "3. x\n4. y\n\n    z"),
    ("<pre><code>a  *b*\n c</code></pre>", "```\na  *b*\n c\n```"), ("<pre>```</pre>", "<pre><code>```</code></pre>"), ("use <code>a_b</code> and <kbd>x`y</kbd>", "use `a_b` and ``x`y``"),
    ("<blockquote><p>a</p><p>b</p></blockquote>c", "> a\n>\n> b\n\nc"), ("a<hr>b", "a\n\n---\n\nb"), ("x<sub>2</sub><sup>3</sup> <del>d</del>", "x<sub>2</sub><sup>3</sup> ~~d~~"),
    ("<table><tr><th>A<th>B<tr><td>1<td>2|3</table>", "| A | B |\n| --- | --- |\n| 1 | 2\\|3 |"),
    ('<table><tr><th colspan="2">A</th><th>B</th></tr><tr><td rowspan=2>1</td><td>2</td><td>3</td></tr><tr><td>4</td><td>5</td></tr></table>', "| A |  | B |\n| --- | --- | --- |\n| 1 | 2 | 3 |\n|  | 4 | 5 |"),
    ("<table><tr><td>a</td><td><p>b</p><p>c</p></td></tr></table>", "| a | b<br>c |\n| --- | --- |"), ("<table><tr><td><div>only</div></td></tr></table>", "only"), ("<table><caption>Cap</caption><tr><th>x</table>", "Cap\n\n| x |\n| --- |"),
    ("a_b *c* 3 * 4 _ 5 [x] <i>`y`</i>", "a\\_b \\*c\\* 3 * 4 _ 5 \\[x\\] *\\`y\\`*"), ("<p>- no list</p><p># no head", "\\- no list\n\n\\# no head"), ("back\\*slash c:\\dir", "back\\\\*slash c:\\dir"),
    ('<p>a<span aria-hidden="true">b</span><script>c()</script><style>d</style></p><svg><text>e</text></svg>', "a"), ("x&nbsp;y", "x y"), ("<div><span>a <div>b</div> c</span></div>", "a\n\nb\n\nc"), ("<p>open <b>never closed", "open **never closed**"),
])
def test_markdown(html, want):
    assert markup.Renderer()(markup.parse(html)) == want


@pytest.mark.parametrize(("mathml", "want"), [
    ("<mi>x</mi><mo>=</mo><mn>1</mn>", "x=1"), ("<mi>α</mi><mi>x</mi>", r"\alpha x"), ("<mi>Γ</mi><mo>+</mo><mi>Χ</mi><mi>ϵ</mi>", r"\Gamma+{\rm X}\varepsilon"), ("<mi>sin</mi><mi>x</mi><mi>foo</mi>", r"\sin x\mathrm{foo}"),
    ("<mfrac><mi>a</mi><mi>b</mi></mfrac>", r"\frac{a}{b}"), ("<msqrt><mi>x</mi><mo>≤</mo><mi>y</mi></msqrt>", r"\sqrt{x\le y}"), ("<mroot><mi>x</mi><mn>3</mn></mroot>", r"\sqrt[3]{x}"), ("<msup><mi>x</mi><mn>2</mn></msup>", "{x}^{2}"),
    ("<msubsup><mo>∫</mo><mn>0</mn><mi>t</mi></msubsup>", r"{\int}_{0}^{t}"), ("<munder><mo>∑</mo><mi>i</mi></munder>", r"\sum_{i}"), ("<mover><mi>x</mi><mo>^</mo></mover>", r"\overset{^}{x}"), ('<mi mathvariant="bold">v</mi>', r"\mathbf{v}"),
    ("<mtable><mtr><mtd><mi>a</mi></mtd><mtd><mi>b</mi></mtd></mtr><mtr><mtd><mi>c</mi></mtd><mtd><mi>d</mi></mtd></mtr></mtable>", r"\begin{matrix} a & b \\ c & d \end{matrix}"),
    ("<mfenced><mi>a</mi><mi>b</mi></mfenced>", r"\left( a, b \right)"), ("<mtext>if x</mtext><mphantom><mi>y</mi></mphantom>", r"\text{if x}\phantom{y}"),
])
def test_mathml(spark, mathml, want):
    assert markup.latex(markup.parse(f"<math>{mathml}</math>").children[0]) == f"$`{want}`$"


def test_pages(spark):
    rows = [(1, "<html><title>T &lt;x</title><body><nav>n</nav><article><h1>H</h1><p>real <b>text</b></p></article><footer>f</footer>"), (2, None), (3, ""), (4, "<div>" * 3000 + "deep")]
    frame = spark.createDataFrame(rows, "page_id long, html string")
    got = {r.page_id: r.m for r in frame.select("page_id", markup.page_markdown(F.col("html")).alias("m")).collect()}
    assert tuple(got[1]) == ("T <x", "# T <x\n\n# H\n\nreal **text**", None) and got[2] is None and tuple(got[3]) == (None, "", None)
    assert got[4].error is not None or got[4].text == "deep"
    math = spark.createDataFrame([('<math display="block"><mi>x</mi></math>',), ("none",), (None,)], "m string")
    assert [r[0] for r in math.select(markup.mathml_latex("m")).collect()] == ["\n$$x$$\n", "none", None]


def test_paper_is_cleaned(spark):
    got = spark.createDataFrame([(PAPER,)], "h string").select(markup.paper_markdown(F.col("h")).alias("m")).first()["m"]
    assert got.error is None and got.text == "## Abstract\n\nThis is the abstract.\n\n## Introduction\n\nInline equation: $E = mc^2$\n\nDisplay equation:\n\n$$\\int_{0}^{\\infty} e^{-x^2} dx$$\n\n* First item\n* Second item"
    kept = markup.clean_paper(markup.parse(PAPER), references=True)
    assert "Reference 1" not in kept.text() and "References" in kept.text() and "John Doe" not in kept.text()


def test_encyclopedia_page_is_cleaned(spark):
    got = spark.createDataFrame([(ENCYCLOPEDIA,)], "h string").select(markup.encyclopedia_markdown(F.col("h")).alias("m")).first()["m"]
    assert got.text == "# Sample Article\n\n# Sample Article\n\nIntroduction with inline math: $E=mc^{2}$\n\n$$\\int_0^\\infty e^{-x} dx = 1$$\n\n## InfoBox\n\n| Type | Example |\n| --- | --- |"
    assert "Reference 1" in markup.clean_encyclopedia(markup.parse(ENCYCLOPEDIA), references=True).text()
    with pytest.raises(ValueError):
        markup.selector("a > b")
