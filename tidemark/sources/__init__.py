"""Scans: bronze, order events, transcripts, audit and metric stores, price list, JDBC tables."""
