"""DataFrame-level operators: dedup, sampling, joins, label bookkeeping, export, planning."""
