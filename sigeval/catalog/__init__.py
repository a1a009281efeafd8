"""Registered queries over the test tables, each next to the SQL that checks it."""
