"""DataFrame → DataFrame operators (churn, monthly, segments, drivers,
cohorts, transaction features, pricing, model evaluation, correlation)."""
