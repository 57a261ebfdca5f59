"""Security policies for LLM output as Spark plans: event and byte streams, policies, scans and static audits."""
