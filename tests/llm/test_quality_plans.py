"""Plans of the quality rules' estimates stay small: the driver plans and compiles them in every step."""

from __future__ import annotations

from lagmill.llm import quality_rules


def test_plans_of_a_step_are_small(spark, monkeypatch):
    sizes, materialize = [], quality_rules.materialize

    def measured(df, label, *parts):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        if label == "mcd":
            sizes.append((plan.count("Join "), plan.count("Project [")))
        return materialize(df, label, *parts)

    monkeypatch.setattr(quality_rules, "materialize", measured)
    monkeypatch.setattr(quality_rules, "MOST_STEPS", 1)
    values = [f"(id * {k} % 13) / 20d AS {c}" for k, c in enumerate(quality_rules.VECTOR, 3)]
    rows = spark.range(40).selectExpr("'s' AS own", "'l' AS whole", *values)
    tree = quality_rules.materialize(spark.createDataFrame([("s", "l", 2, 40), ("l", "table", 1, 40), ("table", None, 0, 40)], "grp string, parent string, depth int, n long"), "tree")
    assert quality_rules.robust_estimates(rows, tree).count() == 3
    assert max(joins for joins, _ in sizes) <= 4 and max(projects for _, projects in sizes) <= 20
