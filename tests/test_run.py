"""The composed run: stages found again, made anew, skipped; the report as JSON."""

import json

from pyspark.sql import functions as F

from panelwright.plans import run


def stages(log, enough=True, factor=2):
    def noted(name, build):
        def made(*tables):
            log.append(name)
            return build(*tables)

        return made

    return lambda spark: [
        run.Stage("base", noted("base", lambda: spark.range(4))),
        run.Stage("double", noted("double", lambda b: b.select((F.col("id") * factor).alias("id"))), ["base"], settings={"factor": factor}),
        run.Stage("checked", noted("checked", lambda d: d), ["double"], lambda d: None if enough else "too few"),
        run.Stage("end", noted("end", lambda c, b: c.union(b)), ["checked", "base"], run.all_there(["checked", "base"])),
        run.Stage("beside", noted("beside", lambda b: b.limit(1)), ["base"]),
    ]


def test_stages_are_found_again_and_guards_hold(spark, tmp_path):
    root, log = str(tmp_path / "stages"), []
    out = run.run_stages(spark, stages(log, enough=False)(spark), root, "files-1")
    assert log == ["base", "double", "beside"]
    assert (out["checked"].state, out["checked"].reason) == (run.SKIPPED, "too few")
    assert (out["end"].state, out["end"].reason) == (run.SKIPPED, "without checked")
    assert not run.publish_outcomes(out, ["base", "end"], str(tmp_path / "published"), "L", "2026-01-01 00:00:00")
    # the next run goes on from the last finished stage
    out = run.run_stages(spark, stages(log)(spark), root, "files-1")
    assert log[3:] == ["checked", "end"] and out["end"].table.count() == 8
    # other settings make a stage and all that needs it anew, other files everything
    run.run_stages(spark, stages(log, factor=3)(spark), root, "files-1")
    assert log[5:] == ["double", "checked", "end"]
    run.run_stages(spark, stages(log)(spark), root, "files-2")
    assert len(log) == 13
    assert run.publish_outcomes(out, ["base", "end"], str(tmp_path / "published"), "L", "2026-01-01 00:00:00")


def test_a_stage_that_died_is_made_again(spark, tmp_path):
    root, log = str(tmp_path / "stages"), []
    first = stages(log)(spark)
    broken = [*first[:1], run.Stage("double", lambda b: b.select(F.raise_error(F.lit("boom")).alias("id")), ["base"], settings={"factor": 2})]
    try:
        run.run_stages(spark, broken, root, "f")
        raise AssertionError("it should have failed")
    except Exception as error:
        assert "boom" in str(error)
    out = run.run_stages(spark, first, root, "f")
    assert {n: o.state for n, o in out.items()}["base"] == run.REUSED and out["double"].state == run.BUILT


def test_the_report_is_json(spark, tmp_path):
    out = run.run_stages(spark, stages([], enough=False)(spark), str(tmp_path / "stages"), "f")
    table = run.report(spark, out)
    assert run.write_report(table, str(tmp_path / "reports"), "L1", "2026-01-01 00:00:00")
    assert not run.write_report(table, str(tmp_path / "reports"), "L1", "2026-01-01 00:00:00")
    lines = [json.loads(x) for x in (tmp_path / "reports/L1.json").read_text().splitlines()]
    items = {(i := json.loads(x["item"]))["stage"]: i for x in lines if x["section"] == "stages"}
    assert items["base"]["rows"] == 4 and items["end"] == {"stage": "end", "state": "skipped", "reason": "without checked"}
