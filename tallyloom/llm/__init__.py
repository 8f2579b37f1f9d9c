"""Operators for preparing training data and resolving persons; nothing outside this subpackage imports it."""
