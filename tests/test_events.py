"""Event XML parsed once against the XPath form that reads every field by itself."""

from pyspark.sql import functions as F

from ferryline.sources import tables as S

EVENT = "<event name='rpc_completed' timestamp='t'>{}<action name='database_name'><value>db</value></action></event>"
STATEMENT = "<data name='statement'><value>{}</value></data>"
ODD = [
    EVENT.format(STATEMENT.format("select 1")),
    EVENT.format(STATEMENT.format("  a &lt; b &amp;&amp; c\n ")),
    EVENT.format(STATEMENT.format("<![CDATA[x < y]]>")),
    EVENT.format(STATEMENT.format("a<!-- c -->b")),
    EVENT.format(STATEMENT.format("a<i>b</i>c")),
    EVENT.format(STATEMENT.format("first") + STATEMENT.format("last")),
    EVENT.format(STATEMENT.format("first") + "<data name='statement'/>"),
    EVENT.format("<data name='statement'><value>one</value><value>two</value></data>"),
    EVENT.format("<data name='statement'><type name='x'/><value>typed</value><text>t</text></data><data name='duration'><value>12</value></data><data name='cpu_time'><value>x</value></data>"),
    EVENT.format(STATEMENT.format("") + "<data name='batch_text'><value>batch</value></data>"),
    EVENT.format("<action name='sql_text'><value>acted</value></action>"),
    EVENT.format(""),
    "<event name='rpc&#95;completed'>" + STATEMENT.format("hidden") + "</event>",
    "<?xml version='1.0'?>" + EVENT.format(STATEMENT.format("prolog")),
    "<other name='rpc_completed'>" + STATEMENT.format("other root") + "</other>",
    "<event>" + STATEMENT.format("no name") + "</event>",
    "<event name='wait_info'>" + STATEMENT.format("other kind") + "</event>",
    EVENT.format(STATEMENT.format("call") + "<data name='parameters'><value><parameter name='@a' type='int'>1</parameter><parameter>2</parameter></value></data>"),
    None,
]


def test_parsed_events_equal_xpath(spark, monkeypatch):
    df = spark.createDataFrame([(x,) for x in ODD], "event_xml string").repartition(2)
    once = S.shred_events(df)
    got = sorted(map(repr, once.collect()))
    assert len(got) == 13
    monkeypatch.setattr(S, "_PLAIN", "^never$")
    assert got == sorted(map(repr, S.shred_events(df).collect()))


def test_plain_events_are_not_read_by_xpath(spark, monkeypatch):
    monkeypatch.setattr(S, "_field", lambda name, kind="data": F.raise_error(F.lit("read by XPath")).cast("string"))
    df = spark.createDataFrame([(ODD[0],), (ODD[8],)], "event_xml string")
    assert sorted(r.sql_text for r in S.shred_events(df).collect()) == ["select 1", "typed"]
