"""DataFrame to DataFrame operators. None of them runs a job or collects rows."""
