"""Set-oriented operators over the catalogue (one module per area)."""
