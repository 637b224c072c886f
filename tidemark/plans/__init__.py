"""Jobs composed from the operators: daily batch, reconciliation, self-test."""
