from __future__ import annotations

import json

from tests.conftest import rows
from textloom.operators.html_blocks import blocks_to_html, html_to_blocks, parse_blocks, parse_tree, pseudo_list, render_block, resolve_image, source_text

PAGE = """<html><head><title>x</title></head><body>
<h1 class="a b" data-mmg-id="chp0-blk0">Head <b>line</b></h1>
<p data-mmg-id="chp0-blk1">One <b>two <i>three</i></b> <a href="#n1" epub:type="noteref">[1]</a><br/><a href="u.html" title="t">link</a> <small>s</small> <u>under</u></p>
<ul><li>a<ul><li>b</li></ul></li><li>c</ul>
<p><img src="../img/pic.png" alt="alt" class="wide"/></p>
<table><thead><tr><th>H</th><th>I</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table>
<table><tr><th>K</th><td>v</td></tr><tr><td>1</td><td>2</td></tr></table>
<pre><code class="language-py">x = 1\n<span class="comment"># c</span><br/>y</code></pre>
<hr class="doc-pagebreak" title="7"/><hr/>
<p><span class="bullet"> </span></p>
<blockquote>quoted</blockquote><script>var a = "</p>";</script>
<p>unclosed<p>next
</body></html>"""


def kinds(blocks):
    return [b["type"] for b in blocks]


def test_parse():
    b = parse_blocks(PAGE, "k", known={"img/pic.png"}, base="text")
    assert kinds(b) == ["heading", "paragraph", "list", "image", "table", "table", "code_block", "marker", "list", "paragraph", "paragraph", "paragraph"]
    assert b[0]["level"] == 1 and b[0]["content_source"] == "Head line" and b[0]["css_classes"] == ["a", "b"] and b[0]["mmg_id"] == "chp0-blk0"
    assert [i["type"] for i in b[1]["content_rich_source"]] == ["text", "bold", "note_reference", "line_break", "hyperlink", "small", "text"]
    assert b[1]["content_rich_source"][1]["content"][1] == {"type": "italic", "content": [{"type": "text", "content": "three"}]}
    assert b[2]["items_source"][0]["nested_list"]["items_source"][0]["content"][0]["content"] == "b" and len(b[2]["items_source"]) == 2
    assert b[3]["path"] == "img/pic.png" and b[3]["container_tag"] == "p" and b[3]["img_css_classes"] == ["wide"]
    assert len(b[4]["content_source"]["headers"]) == 2 and len(b[4]["content_source"]["rows"]) == 1
    assert len(b[5]["content_source"]["headers"]) == 2 and len(b[5]["content_source"]["rows"]) == 1
    assert b[6]["language"] == "py" and [(x["type"], x["value"]) for x in b[6]["content_structured_source"]] == [("code", "x = 1"), ("comment", "# c"), ("code", "y")]
    assert b[7]["title"] == "7" and b[8]["css_classes"] == ["pseudo-list-generated", "bullet"]
    assert [x["content_source"] for x in b[9:]] == ["quoted", "unclosed", "next"]
    assert "paragraph" not in kinds(parse_blocks("<blockquote>q</blockquote>", keep_unknown=False))
    assert len({x["id"] for x in b}) == len(b) and b == parse_blocks(PAGE, "k", known={"img/pic.png"}, base="text")


def test_edges():
    assert parse_blocks(None) == [] and parse_blocks("") == [] and parse_blocks("bare text") == [] and parse_blocks("<p>a", unwrap=True)[0]["content_source"] == "a"
    assert kinds(parse_blocks("<section><div><p>a</p></div><h2>b</h2></section>", unwrap=True)) == ["paragraph", "heading"]
    assert resolve_image("a/x.png", "", {"i/x.png"}) == "i/x.png" and resolve_image("x.png", "", {"i/x.png", "j/x.png"}) == "x.png" and resolve_image("q.png", "", set()) == "q.png"
    assert pseudo_list([next(parse_tree("<p class='bullet'>x</p>").elements("p"))])["css_classes"] == ["bullet", "pseudo-list-marker"]


def strip(b):
    return [{k: v for k, v in x.items() if k not in ("id", "container_tag", "path", "css_classes")} for x in b]


def test_round_trip():
    b = parse_blocks(PAGE, "k")
    again = parse_blocks("".join(render_block(x) for x in b), "k")
    assert kinds(again) == kinds(b)
    # An image loses its folder, and a list of a blank bullet its blank.
    same = [i for i, x in enumerate(b) if x["type"] != "image" and i != 8]
    assert [strip(again)[i] for i in same] == [strip(b)[i] for i in same]
    assert all(x.get("mmg_id") == y.get("mmg_id") for x, y in zip(b, again, strict=True))


def test_render_targets_and_notes():
    assert render_block({"type": "heading", "level": 2, "content_source": "a", "content_target": "b & c"}) == "<h2>b &amp; c</h2>"
    note = {"type": "note_content", "id": "n1", "content_source": [{"type": "paragraph", "content_rich_source": ["bare", {"type": "underline", "content": "u"}]}]}
    assert render_block(note) == '<div id="n1"><p>bareu</p></div>' and render_block({"type": "marker", "role": "other"}) == "" and render_block({}) == ""
    assert source_text({"type": "list", "items_source": [{"content": ["a"]}, "b"]}) == "a b" and source_text({"type": "table"}) == ""


def test_frames(spark):
    df = spark.createDataFrame([("d", "<p>x</p><h1>y</h1>"), ("e", None), ("f", ""), ("d", "<p>x</p>")], "k string, h string").selectExpr("*", "1 AS block_no")
    assert rows(html_to_blocks(df, "k", "h"), "doc_key", "block_no", "block_type", "level") == [("d", 0, "paragraph", None), ("d", 0, "paragraph", None), ("d", 1, "heading", 1)]
    content = json.dumps([{"type": "heading", "level": 1, "content_source": "t"}, "s", {"no": "type"}])
    back = spark.createDataFrame([("a", content), ("b", "broken ["), ("c", None)], "k string, c string")
    assert rows(blocks_to_html(back, "k", "c")) == [("a", 0, "heading", "<h1>t</h1>"), ("a", 2, None, "")]
    assert rows(html_to_blocks(df.limit(0), "k", "h")) == []


def test_depth_is_no_limit(spark):
    n = 5000
    inline, lists, notes = "bold", {"type": "list", "items_source": []}, {"type": "note_content", "id": "n", "content_source": [{"type": "paragraph", "content_source": "in"}]}
    for i in range(n):
        inline = {"type": "bold", "content": [inline]}
        lists = {"type": "list", "items_source": [{"content": "x", "nested_list": lists}]}
        notes = {"type": "note_content", "id": f"n{i}", "content_source": [notes]}
    html = [render_block(b) for b in ({"type": "paragraph", "content_rich_source": [inline]}, lists, notes)]
    assert html[0].count("<b>") == n and html[1].count("<li>") == n and html[2].count("<div") == n + 1
    for text, kind in zip(html, ("paragraph", "list", "note_content"), strict=True):
        found = parse_blocks(text)
        assert kinds(found) == [kind]
        again = render_block(found[0])
        assert again == text or kind != "paragraph" and abs(len(again) - len(text)) < 100
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(html)], "k string, h string")
    back = html_to_blocks(df, "k", "h")
    assert rows(back, "doc_key", "block_type") == [("0", "paragraph"), ("1", "list"), ("2", "note_content")]
    assert rows(blocks_to_html(back, "doc_key", "block"), "doc_key", "block_type") == rows(back, "doc_key", "block_type")
