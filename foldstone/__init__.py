"""Event-log analytics as Spark jobs: read models, audits, lineage, policy and package reports."""
