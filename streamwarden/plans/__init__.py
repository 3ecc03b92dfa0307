"""Continuous-query specs, named templates and the registered queries."""
