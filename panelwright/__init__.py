"""Panels, month-end series, lagged statistics and panel models as Spark jobs."""
