"""Jobs built from the operators: clean layer, star schema, KPIs, reports."""
