"""Requests, cases, catalogs, reports and grids."""
