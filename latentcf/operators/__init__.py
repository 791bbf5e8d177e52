"""Operators: split, EM (staged long form and wide engine), scoring, evaluation, topics."""
