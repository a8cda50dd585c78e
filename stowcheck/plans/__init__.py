"""Registered queries, their SQL twins and the composed health report."""
