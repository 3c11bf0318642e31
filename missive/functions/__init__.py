"""Column functions and the Arrow functions behind them."""
