"""The products a user asks for, each a function from tables to a DataFrame."""
