"""Automata, token sets, scans, certificates, plans, recovery and modes."""
