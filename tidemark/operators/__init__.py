"""Table operators: conformance, quality, modelling, KPIs, analysis."""
