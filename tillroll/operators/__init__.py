"""Operators: reports (U1-U5), customer metrics, segmentation, insights and
the rule-based playbook. All are ``f(DataFrame, ...) -> DataFrame``."""
