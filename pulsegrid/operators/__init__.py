"""Relational operators over telemetry, alerts, KPIs and their operational data."""
