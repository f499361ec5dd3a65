"""Operators: summary builders (A*), roll-ups (R*), joins (J*), maintenance (M*)."""
