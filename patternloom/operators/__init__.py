"""Operators: DataFrame in, DataFrame out; lazy but where a docstring says otherwise."""
