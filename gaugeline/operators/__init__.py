"""DataFrame -> DataFrame operators; all lazy unless a docstring says otherwise."""
