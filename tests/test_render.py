"""The HTML view, rule by rule."""

from __future__ import annotations

import pytest

from marlow.functions.render import contents, render


@pytest.mark.parametrize(("xml", "html"), [
    ("<prov id='S'><label>3</label><prov.body><subprov><label>1</label></subprov></prov.body></prov>", '<section class="prov" id="S" data-location="s 3"><span class="label">3</span><div class="prov.body"><div class="subprov" data-location="s 3(1)"><span class="label">1</span></div></div></section>'),
    ("<schedule><label>2</label><prov><label>4</label></prov></schedule>", '<section class="schedule" data-location="sch 2"><span class="label">2</span><section class="prov" data-location="sch 2 cl 4"><span class="label">4</span></section></section>'),
    ("<table><tgroup><colspec colname='a' colwidth='1*'/><colspec colname='b' colwidth='3*'/><tbody><row><entry namest='a' nameend='b' morerows='1'>x</entry></row></tbody></tgroup></table>", '<table><colgroup><col style="width: 25%"><col style="width: 75%"></colgroup><tbody class="tbody"><tr class="row"><td colspan="2" rowspan="2">x</td></tr></tbody></table>'),
    ("<equation><fraction><numerator>a</numerator><denominator>b</denominator></fraction></equation>", "<math><mfrac><mrow>a</mrow><mrow>b</mrow></mfrac></math>"),
    ("<def-para id='D'><para><text><def-term>ship</def-term> is a <b>&amp;</b></text></para></def-para>", '<div class="def-para" id="D" data-term="ship"><div class="para"><p class="text"><dfn class="def-term">ship</dfn> is a <div class="b">&amp;</div></p></div></div>'),
    ("<intituling><court>High Court</court></intituling>", '<header class="intituling"><div class="court"><span class="field">Court</span> High Court</div></header>'),
    ("<paragraph><label>[7]</label><text>It began.</text></paragraph>", '<div class="paragraph" id="para-7"><span class="label">[7]</span><p class="text">It began.</p></div>'),
    ("<graphic file='a.png' alt='map'/>", '<img alt="map" src="a.png">'),
    ("<text>a <insert>b</insert><strike>c</strike></text>", '<p class="text">a <ins class="insert">b</ins><del class="strike">c</del></p>'),
])
def test_rules(xml, html):
    assert render(xml) == html


def test_changes_made():
    assert render("<text>a <insert>b</insert><strike>c</strike></text>", changes=False) == '<p class="text">a b</p>'


def test_contents():
    xml = "<act><body><part><label>1</label><heading>Ports &amp; ships</heading><prov><label>2</label><heading>Dues</heading></prov><prov toc='no'><label>3</label></prov></part></body></act>"
    assert contents(xml) == '<ul><li data-location="part 1">1 Ports &amp; ships<ul><li data-location="part 1 s 2">2 Dues</li></ul></li></ul>'
    assert contents(None) is None
    assert contents("<a") is None
