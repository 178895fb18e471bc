"""Run evaluation, registry, history, metrics, panels and alert rules."""
