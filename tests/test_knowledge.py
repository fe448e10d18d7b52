import pytest

from intervallum.functions import registry
from intervallum.plans import model as M
from intervallum.plans.knowledge import DefinitionError, KnowledgeBase, parse
from intervallum.queries.abstraction import KB

HEAD = "<categories>c</categories><description>d</description>"


def raw(name="G", kind="raw-numeric", body='<attribute name="G" type="numeric"><numeric-allowed-values><allowed-value min="0" max="600"/></numeric-allowed-values></attribute>', rest=""):
    return f'<raw-concept name="{name}" concept-type="{kind}">{HEAD}<attributes>{body}</attributes>{rest}</raw-concept>'


STATE = f'<state name="S">{HEAD}<derived-from name="G" tak="raw-concept"/><persistence good-after="24h" interpolate="true" max-skip="1"/><abstraction-rules><rule value="Low" operator="and"><attribute idx="0"><allowed-value max="70"/></attribute></rule></abstraction-rules></state>'
TREND = f'<trend name="T">{HEAD}<derived-from name="G" tak="raw-concept" significant-variation="40"/><time-steady value="12h"/><persistence good-after="24h"/></trend>'
EVENT = f'<event name="E">{HEAD}<derived-from><attribute name="G" tak="raw-concept" idx="0" ref="A1"/></derived-from><abstraction-rules><rule value="Hypo"><attribute ref="A1"><allowed-value max="70"/></attribute></rule></abstraction-rules></event>'
CONTEXT = f'<context name="C">{HEAD}<derived-from><attribute name="E" tak="event" ref="A1"/></derived-from><clippers><clipper name="G" tak="raw-concept" clip-after="4h"/></clippers><abstraction-rules><rule value="True"><attribute ref="A1"><allowed-value equal="Hypo"/></attribute></rule></abstraction-rules><context-windows><persistence value="True" good-before="1h" good-after="2h"/></context-windows></context>'
PARAM = f'<parameterized-raw-concept name="R">{HEAD}<derived-from name="G" tak="raw-concept"/><parameters><parameter name="G" tak="raw-concept" idx="0" how="before" dynamic="true" ref="P1"/></parameters><functions><function name="div"><value idx="0"/><parameter ref="P1"/></function></functions></parameterized-raw-concept>'
LOCAL = f'<pattern name="L" concept-type="local-pattern">{HEAD}<derived-from><attribute name="E" tak="event" ref="A1"/><attribute name="G" tak="raw-concept" idx="0" ref="E1"/></derived-from><abstraction-rules><rule><temporal-relation how="before" max-distance="72h"><anchor><attribute ref="A1"><allowed-value equal="Hypo"/></attribute></anchor><event select="first"><attribute ref="E1"><allowed-value min="10"/></attribute></event></temporal-relation><compliance-function><time-constraint-compliance><function name="id"><trapez trapezA="0h" trapezB="0h" trapezC="48h" trapezD="72h"/></function></time-constraint-compliance></compliance-function></rule></abstraction-rules></pattern>'
GLOBAL = f'<pattern name="W" concept-type="global-pattern">{HEAD}<derived-from><attribute name="G" tak="raw-concept" idx="0" ref="E1"/></derived-from><parameters><parameter name="X" tak="raw-concept" ref="P1" default="2"/></parameters><abstraction-rules><rule><cyclic start="0h" end="2d" time-window="12h" min-occurrences="1" max-occurrences="3"><event><attribute ref="E1"><allowed-value min="1"/></attribute></event></cyclic><compliance-function><value-constraint-compliance><target><attribute ref="E1"/></target><function name="mul"><parameter ref="P1"/><trapez trapezA="0" trapezB="1" trapezC="2" trapezD="3"/></function></value-constraint-compliance></compliance-function></rule></abstraction-rules></pattern>'
ALL = (raw(), STATE, TREND, EVENT, CONTEXT, PARAM, LOCAL, GLOBAL)


def test_read_folder(tmp_path):
    for i, text in enumerate(ALL):
        (tmp_path / f"{i}.xml").write_text('<?xml version="1.0" encoding="UTF-8"?>' + text)
    (tmp_path / "global_clippers.json").write_text('{"global_clippers": [{"name": "A", "how": "START"}]}')
    kb = KnowledgeBase.read(tmp_path)
    assert kb.order() == ["G", "R", "E", "S", "T", "C", "L", "W"]
    assert kb.by_name["S"].good_after == 86_400 and kb.by_name["S"].interpolate and kb.by_name["S"].rules[0].operator == "and"
    assert kb.by_name["C"].windows == {"True": M.Window(3600, 7200)} and kb.by_name["C"].clippers[0].before is None
    assert kb.clippers == (M.GlobalClipper("A", "START"),)
    assert kb.closure(["L"]) == {"L", "E", "G"} and kb.dependants(["E"]) == {"E", "C", "L"}
    assert kb.unused() == ["C", "R"]
    again = KnowledgeBase.from_json(kb.to_json())
    assert again.by_name == kb.by_name and again.clippers == kb.clippers


def test_round_trip_and_metadata(spark):
    assert KnowledgeBase.from_json(KB.to_json()).by_name == KB.by_name
    rows = KB.check().metadata(spark).collect()
    assert len(rows) == len(KB.by_name) and rows[0].family == "raw-concept"


BAD = [
    "<state name='S'>", "<thing name='x'/>", raw(body=""), raw(kind="raw"), raw(body='<attribute name="G" type="numeric"/>'),
    raw(body='<attribute name="G" type="numeric"><numeric-allowed-values><allowed-value min="9" max="1"/></numeric-allowed-values></attribute>'),
    raw(kind="raw-nominal", body='<attribute name="G" type="nominal"><nominal-allowed-values><allowed-value value="a"/><allowed-value value="a"/></nominal-allowed-values></attribute>'),
    STATE.replace('good-after="24h"', 'good-after="0h"'), STATE.replace('good-after="24h"', 'good-after="soon"'), STATE.replace('max="70"', 'min="70" max="60"'),
    STATE.replace('<allowed-value max="70"/>', '<allowed-value max="70"/><allowed-value min="60" max="80"/>'),
    PARAM.replace('how="before"', 'how="all"'), PARAM.replace('dynamic="true"', 'dynamic="false" good-before="1h"'), PARAM.replace('dynamic="true"', 'dynamic="true" good-after="1h"'), PARAM.replace('"div"', '"nothing"'), PARAM.replace('<parameter ref="P1"/>', '<parameter ref="P2"/>'),
    EVENT.replace('ref="A1"><allowed', 'ref="A9"><allowed'), CONTEXT.replace(' clip-after="4h"', ""), CONTEXT.replace('persistence value="True"', 'persistence value="Other"'),
    LOCAL.replace(' max-distance="72h"', ""), LOCAL.replace('max-distance="72h"', 'max-distance="48h"'), LOCAL.replace('how="before"', 'how="overlap"'), LOCAL.replace('trapezB="0h"', 'trapezB="60h"'),
    LOCAL.replace('<derived-from>', '<parameters/><derived-from>'), GLOBAL.replace(' default="2"', ""), GLOBAL.replace('concept-type="global-pattern"', 'concept-type="global-pattern" ignore-unfulfilled-anchors="true"'), GLOBAL.replace('<target><attribute ref="E1"/></target>', ""),
    GLOBAL.replace('name="mul"', 'name="id_if_thresh_met"'),
]


@pytest.mark.parametrize("text", BAD)
def test_refused(text):
    with pytest.raises(ValueError):
        parse(text)


def test_refused_together():
    g, e = parse(raw()), parse(EVENT)
    with pytest.raises(DefinitionError):
        KnowledgeBase([g, g])
    with pytest.raises(DefinitionError):
        KnowledgeBase([e]).check()
    a = M.Event("A", derived=(M.Source("B", "event", 0, "x"),), rules=(M.Rule("v", (M.Condition("x", (M.Bound("v"),)),)),))
    b = M.Event("B", derived=(M.Source("A", "event", 0, "x"),), rules=(M.Rule("v", (M.Condition("x", (M.Bound("v"),)),)),))
    with pytest.raises(DefinitionError, match="need each other"):
        KnowledgeBase([a, b]).check()
    with pytest.raises(DefinitionError, match="numeric"):
        KnowledgeBase([g, parse(EVENT.replace('max="70"', 'equal="low"'))]).check()
    with pytest.raises(DefinitionError, match="never"):
        KnowledgeBase([g, e, parse(LOCAL.replace('equal="Hypo"', 'equal="Hyper"'))]).check()
    with pytest.raises(DefinitionError, match="not a"):
        KnowledgeBase([g, parse(STATE.replace('tak="raw-concept"', 'tak="event"'))]).check()


def test_durations_and_functions():
    assert registry.parse_duration("1d12h") == 129_600 and registry.parse_duration("2M") == 5_184_000 and registry.parse_duration("1y") == 31_536_000
    for bad in ("", "h", "5", "5x", "1h z"):
        with pytest.raises(ValueError):
            registry.parse_duration(bad)
    with pytest.raises(ValueError):
        registry.register("id")(lambda x: x)
    with pytest.raises(ValueError):
        registry.call("nothing")
    with pytest.raises(ValueError):
        M.Trapezoid(0, 2, 1, 3)
    assert M.Trapezoid(0, 0, 1, 2).missing_score == 1.0 and M.Trapezoid(0, 1, 2, 2, True).missing_score == 1.0 and M.Trapezoid(0, 1, 2, 3).missing_score == 0.0
