"""Column-level building blocks (text rules, gates, calendar, scores, answers, prompts)."""
