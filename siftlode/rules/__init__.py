"""Extraction rules: a small language of CSS, JSONPath, XPath, index and getter steps."""
