"""DataFrame -> DataFrame operators; keys and parameters are arguments."""
