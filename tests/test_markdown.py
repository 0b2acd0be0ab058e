import pytest
from pyspark.sql import functions as F

from lumenline.plans import markdown

CASES = {
    "math": ("- The formula is $E = mc^2$\n- A display equation:\n\n$$\\frac{1}{3}$$\n", "<ul>\n<li>The formula is $E = mc^2$</li>\n<li>A display equation:</li>\n</ul>\n<p>$$\\frac{1}{3}$$</p>"),
    "math in emphasis": ("a $x_1 * y_1$ and $x_2 * y_2$ *so*", "<p>a $x_1 * y_1$ and $x_2 * y_2$ <em>so</em></p>"),
    "image tag": ('<img src="slides/a.png">', '<img src="/files/slides/a.png">'),
    "absolute": ('<img src="/files/a.png">', '<img src="/files/a.png">'),
    "data": ('<img src="data:image/png;base64,abc">', '<img src="data:image/png;base64,abc">'),
    "https": ('<img src="https://example.com/p.png">', '<img src="https://example.com/p.png">'),
    "contents": ("# Table of Contents\n\n- [lecture01](#lecture01)\n", '<h1>Table of Contents</h1>\n<ul>\n<li><a href="#lecture01">lecture01</a></li>\n</ul>'),
    "headings": ("# lecture01\n\n## Introduction ##\n\n- point one\n", "<h1>lecture01</h1>\n<h2>Introduction</h2>\n<ul>\n<li>point one</li>\n</ul>"),
    "fence": ('```python\nprint("<hi> *a*")\n\n# no heading\n```\n', '<pre><code class="language-python">print("&lt;hi&gt; *a*")\n\n# no heading\n</code></pre>'),
    "open fence": ("```\na", "<p>```\na</p>"),
    "fence after text": ("say\n~~~\nx\n~~~\ndone", "<p>say</p>\n<pre><code>x\n</code></pre>\n<p>done</p>"),
    "table": ("| a | b |\n|---|:--|\n| 1 | **2** |\n| 3 | 4 |\n\nx", "<table>\n<thead>\n<tr>\n<th>a</th>\n<th>b</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td>1</td>\n<td><strong>2</strong></td>\n</tr>\n<tr>\n<td>3</td>\n<td>4</td>\n</tr>\n</tbody>\n</table>\n<p>x</p>"),
    "no table": ("a | b\nc | d", "<p>a | b\nc | d</p>"),
    "nested": ("- a\n    1. b\n    2. c\n        - d\n- e", "<ul>\n<li>a<ol>\n<li>b</li>\n<li>c<ul>\n<li>d</li>\n</ul>\n</li>\n</ol>\n</li>\n<li>e</li>\n</ul>"),
    "kinds": ("- a\n\n1. b\n2. c", "<ul>\n<li>a</li>\n</ul>\n<ol>\n<li>b</li>\n<li>c</li>\n</ol>"),
    "leap": ("- a\n        - b\n    - c", "<ul>\n<li>a<ul>\n<li>b</li>\n</ul>\n<ul>\n<li>c</li>\n</ul>\n</li>\n</ul>"),
    "more": ("- a\nb\n\nc", "<ul>\n<li>a\nb</li>\n</ul>\n<p>c</p>"),
    "inline": ("**b** *i* `a<*b*>` ![x](p.png) [l](u) 1 < 2 & 3 &amp; snake_case_name _e_", '<p><strong>b</strong> <em>i</em> <code>a&lt;*b*&gt;</code> <img alt="x" src="/files/p.png" /> <a href="u">l</a> 1 &lt; 2 &amp; 3 &amp; snake_case_name <em>e</em></p>'),
    "quote and rule": ("> a\n> b\n\n---\n\nc\nd\n\ne", "<blockquote>\n<p>a\nb</p>\n</blockquote>\n<hr />\n<p>c\nd</p>\n<p>e</p>"),
    "empty": ("", ""),
    "blank": (" \n\n", ""),
    "null": (None, ""),
}


@pytest.fixture(scope="module")
def pages(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "name string, text string")
    return {r.name: r.out for r in markdown.rendered(df).withColumn("out", markdown.preview_sources("html")).collect()}


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(pages, name):
    assert pages[name] == CASES[name][1]


def test_sources_for_printing(spark):
    row = spark.createDataFrame([('<img src="../a.png"><img src="b.png"><img src="/c.png"><img src="file:d">',)], "html string").select(markdown.printed_sources("html", "/out/notes").alias("x")).first()
    assert row.x == '<img src="/out/a.png"><img src="/out/notes/b.png"><img src="/c.png"><img src="file:d">'


def test_tags_balance_whatever_the_lines(spark):
    import random
    import re

    rng = random.Random(5)
    lines = ["- a", "    - b", "        1. c", "1. d", "    2. e", "", "text", "# h", "> q", "| a | b |", "|---|---|", "---", "```", "code"]
    docs = [(str(i), "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 14)))) for i in range(150)]
    for r in markdown.rendered(spark.createDataFrame(docs, "name string, text string")).collect():
        stack = []
        for shut, tag in re.findall(r"<(/?)(\w+)[^>]*?(?<!/)>", r.html):
            if shut:
                assert stack and stack.pop() == tag, (r.text, r.html)
            else:
                stack.append(tag)
        assert not stack, (r.text, r.html)


def test_long_documents(spark):
    df = spark.createDataFrame([("a", "x")], "name string, text string").withColumn("text", F.repeat(F.lit("- item $a_1$\n\n"), 20_000))
    assert markdown.rendered(df).select(F.regexp_count("html", F.lit("<li>")).alias("n"), F.regexp_count("html", F.lit("<ul>")).alias("u")).first() == (20_000, 1)
