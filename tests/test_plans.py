"""Plan shape guards: the scale properties the design relies on."""

from paths import SF001
from quarry.operators import cascade as C
from quarry.plans import queries as Q
from quarry.plans.rules import three_judges


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_row_local_operators_do_not_shuffle(spark):
    for name in ("paragraphs_fallback", "pack_chunks", "html_paragraphs", "parse_verdicts"):
        plan = _plan(getattr(Q, name)(spark, SF001))
        assert "Exchange" not in plan, name


def test_rule_cascade_adds_no_shuffle(spark):
    paras = Q.document_paragraphs(spark, SF001)
    res = C.cascade_rules(paras, three_judges(), ["doc_id", "passage_no"])
    assert "Exchange" not in _plan(res)


def test_scans_read_only_needed_columns(spark):
    plan = _plan(Q.paragraphs_fallback(spark, SF001))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    plan = _plan(Q.validate_jobs(spark, SF001))
    assert "ReadSchema: struct<lang:string,source:string,n_chars:bigint>" in plan


def test_hot_key_numbering_is_blocked(spark):
    # stanza numbering across turns: the window is partitioned by (conversation, block)
    plan = _plan(Q.txt_stanzas(spark, SF001))
    assert "__blk1" in plan
