"""Metric operators: segments, funnel, orders, balance, subscriptions, ad hoc."""
