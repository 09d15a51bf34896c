"""The tools: transforms, aggregates, bins, profiles, reports, crosstabs and charts."""
