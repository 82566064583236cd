"""From specification text to DataFrame plans."""
