"""The rules of classification."""

from __future__ import annotations

from .rules import Rule

# Contracts, methods and selectors as their chains have them.
POOLS = (".poolv1.near", ".pool.near", "aurora.pool.near")
DEXES = ("v2.ref-finance.near", "ref-finance.near", "jumbo_exchange.near")
LENDERS = ("burrow.near", "contract.main.burrow.near")
CALL, MOVE = ("FUNCTION_CALL",), ("TRANSFER",)

DEX_SELECTORS = {
    "0x38ed1739": "swapExactTokensForTokens", "0x8803dbee": "swapTokensForExactTokens", "0x7ff36ab5": "swapExactETHForTokens", "0x4a25d94a": "swapTokensForExactETH", "0x18cbafe5": "swapExactTokensForETH",
    "0xfb3bdb41": "swapETHForExactTokens", "0x414bf389": "exactInputSingle", "0xc04b8d59": "exactInput", "0xdb3e2198": "exactOutputSingle", "0xf28c0498": "exactOutput",
}
LENDING_SELECTORS = {"0xe8eda9df": ("deposit", "collateral_in"), "0x69328dec": ("withdraw", "collateral_out"), "0xa415bcad": ("borrow", "loan_borrow"), "0x573ade81": ("repay", "loan_repay"), "0xd65dc7a1": ("flashLoan", "loan_borrow")}
LP_SELECTORS = {
    "0xe8e33700": ("addLiquidity", "liquidity_in"), "0xf305d719": ("addLiquidityETH", "liquidity_in"), "0xbaa2abde": ("removeLiquidity", "liquidity_out"), "0x02751cec": ("removeLiquidityETH", "liquidity_out"),
    "0xaf2979eb": ("removeLiquidityETHSupportingFeeOnTransferTokens", "liquidity_out"), "0x2195995c": ("removeLiquidityWithPermit", "liquidity_out"),
}

NEAR = [
    Rule("near_staking_deposit", "near", "stake", 0.95, 100, CALL, ("deposit_and_stake", "stake", "deposit"), suffix=POOLS),
    Rule("near_unstaking", "near", "unstake", 0.95, 100, CALL, ("unstake", "unstake_all"), suffix=POOLS),
    Rule("near_staking_withdrawal", "near", "unstake", 0.9, 100, CALL, ("withdraw", "withdraw_all"), suffix=POOLS),
    Rule("near_validator_ping", "near", "internal", 0.99, 100, CALL, ("ping",), suffix=POOLS),
    Rule("near_staking_reward", "near", "reward", 0.85, 100, direction="in", amount_above=0, suffix=POOLS),
    Rule("near_dex_swap_out", "near", "trade", 0.9, 90, CALL, ("swap", "ft_transfer_call"), direction="out", among=DEXES),
    Rule("near_dex_swap_in", "near", "trade", 0.85, 90, direction="in", amount_above=0, among=DEXES),
    Rule("near_lending_deposit", "near", "collateral_in", 0.9, 80, CALL, ("supply", "deposit"), among=LENDERS),
    Rule("near_lending_withdrawal", "near", "collateral_out", 0.9, 80, CALL, ("withdraw",), among=LENDERS),
    Rule("near_borrow", "near", "loan_borrow", 0.9, 80, CALL, ("borrow",), among=LENDERS),
    Rule("near_loan_repay", "near", "loan_repay", 0.9, 80, CALL, ("repay",), among=LENDERS),
    Rule("near_lending_interest", "near", "interest", 0.85, 80, CALL, ("claim_reward",), among=LENDERS),
    Rule("near_lp_add", "near", "liquidity_in", 0.9, 70, CALL, ("add_liquidity", "add_stable_liquidity"), among=DEXES),
    Rule("near_lp_remove", "near", "liquidity_out", 0.9, 70, CALL, ("remove_liquidity",), among=DEXES),
    Rule("near_nft_mint", "near", "nft_mint", 0.95, 60, CALL, ("nft_mint", "nft_mint_batch")),
    Rule("near_airdrop_claim", "near", "airdrop", 0.85, 60, CALL, ("claim", "claim_airdrop", "claim_tokens")),
    Rule("near_system_staking_reward", "near", "reward", 0.99, 95, MOVE, direction="in", exact="system"),
    Rule("near_farming_claim_reward", "near", "reward", 0.95, 85, CALL, ("claim_reward_by_seed", "account_farm_claim_all", "withdraw_reward", "claim_reward")),
    Rule("near_wnear_wrap", "near", "trade", 0.95, 85, CALL, ("near_deposit",), exact="wrap.near"),
    Rule("near_wnear_unwrap", "near", "trade", 0.95, 85, CALL, ("near_withdraw",), exact="wrap.near"),
    Rule("near_wnear_unwrap_receipt", "near", "trade", 0.95, 85, MOVE, direction="in", exact="wrap.near"),
    Rule("near_burrow_oracle_call", "near", "internal", 0.99, 85, CALL, ("oracle_call",), exact="priceoracle.near"),
    Rule("near_burrow_execute_pyth", "near", "internal", 0.95, 85, CALL, ("execute_with_pyth",), among=LENDERS),
    Rule("near_intents_swap_receipt", "near", "trade", 0.95, 85, MOVE, direction="in", exact="intents.near"),
    Rule("near_dex_swap_receipt", "near", "trade", 0.95, 85, MOVE, direction="in", among=(*DEXES, "dclv2.ref-labs.near", "dcl.ref-labs.near")),
    Rule("near_liquid_staking_receipt", "near", "unstake", 0.9, 80, MOVE, direction="in", among=("meta-pool.near", "linear-protocol.near")),
    Rule("near_inscription", "near", "internal", 0.95, 70, CALL, ("inscribe",), exact="inscription.near"),
    Rule("near_social_operations", "near", "internal", 0.99, 60, CALL, ("set",), exact="social.near"),
    Rule("near_did_operations", "near", "internal", 0.99, 60, CALL, ("storeAlias", "storeSchema", "storeDefinition", "deleteSchema", "deleteDefinition", "putDID")),
    Rule("near_dao_payout", "near", "income", 0.9, 55, MOVE, direction="in", suffix=(".cdao.near", ".sputnikdao.near")),
    Rule("near_voting", "near", "internal", 0.99, 55, CALL, ("vote", "act_proposal")),
    Rule("near_transfer_near_method", "near", "withdrawal", 0.9, 55, CALL, ("transfer_near",)),
    Rule("near_mft_transfer_call", "near", "trade", 0.85, 55, CALL, ("mft_transfer_call",)),
    Rule("near_deltatrade_receipt", "near", "trade", 0.9, 55, MOVE, direction="in", suffix=(".deltatrade.near",)),
    Rule("near_nf_payout", "near", "nft_sale", 0.85, 55, MOVE, direction="in", among=("nf-payments.near", "nf-finance.near")),
    Rule("near_ft_transfer_in_own", "near", "transfer_in", 0.9, 50, CALL, ("ft_transfer", "ft_transfer_call"), direction="in", own=True),
    Rule("near_ft_transfer_out_own", "near", "transfer_out", 0.9, 50, CALL, ("ft_transfer", "ft_transfer_call"), direction="out", own=True),
    Rule("near_transfer_in", "near", "deposit", 0.9, 50, MOVE, direction="in"),
    Rule("near_transfer_out", "near", "withdrawal", 0.9, 50, MOVE, direction="out"),
    Rule("near_account_create", "near", "account_create", 0.95, 50, ("CREATE_ACCOUNT",)),
    Rule("near_key_management", "near", "internal", 0.99, 50, ("ADD_KEY", "DELETE_KEY")),
    Rule("near_storage_ops", "near", "fee", 0.9, 50, CALL, ("storage_deposit", "storage_withdraw")),
]

EVM = [
    *(Rule(f"evm_dex_swap_{m.lower()}", "evm", "trade", 0.9, 90, selector=s) for s, m in DEX_SELECTORS.items()),
    *(Rule(f"evm_lending_{m.lower()}", "evm", c, 0.85, 80, selector=s) for s, (m, c) in LENDING_SELECTORS.items()),
    *(Rule(f"evm_lp_{m.lower()}", "evm", c, 0.85, 70, selector=s) for s, (m, c) in LP_SELECTORS.items()),
    Rule("evm_plain_transfer_in", "evm", "deposit", 0.7, 50, direction="in", selector=""),
    Rule("evm_plain_transfer_out", "evm", "withdrawal", 0.7, 50, direction="out", selector=""),
]

# Fixed values: (name, category, confidence, transaction types) of exchange rules.
EXCHANGE_TYPES = (
    ("exchange_buy", "buy", 0.95, ("buy", "purchase")), ("exchange_sell", "sell", 0.95, ("sell", "sale")), ("exchange_swap", "trade", 0.95, ("swap", "convert", "trade")), ("exchange_staking_reward", "reward", 0.95, ("staking_reward",)),
    ("exchange_interest", "interest", 0.95, ("interest",)), ("exchange_reward", "reward", 0.95, ("reward",)), ("exchange_dividend", "income", 0.95, ("dividend",)), ("exchange_airdrop", "airdrop", 0.9, ("airdrop",)),
    ("exchange_withdrawal", "withdrawal", 0.8, ("send", "withdrawal")), ("exchange_deposit", "deposit", 0.8, ("receive", "deposit")), ("exchange_crypto_viban", "sell", 0.9, ("crypto_viban",)),
    ("exchange_crypto_viban_exchange", "trade", 0.9, ("crypto_viban_exchange",)), ("exchange_viban_deposit", "deposit", 0.9, ("viban_deposit", "viban_purchase")), ("exchange_viban_withdrawal", "withdrawal", 0.9, ("viban_withdrawal",)),
    ("exchange_crypto_transfer_in", "transfer_in", 0.85, ("exchange_to_crypto_transfer", "crypto_transfer")), ("exchange_crypto_earn_deposit", "stake", 0.9, ("crypto_earn_program_created", "crypto_earn_program_deposit", "lockup_lock")),
    ("exchange_crypto_earn_withdraw", "unstake", 0.9, ("crypto_earn_program_withdrawn", "crypto_earn_program_withdrawal", "lockup_unlock")), ("exchange_crypto_earn_interest", "interest", 0.95, ("crypto_earn_interest_paid",)),
    ("exchange_referral_bonus", "reward", 0.9, ("referral_bonus", "referral_card_cashback", "reimbursement", "card_cashback_reverted")),
)
EXCHANGE = [Rule(n, "exchange", c, p, 40, tx_type=t) for n, c, p, t in EXCHANGE_TYPES]

ALL = [*NEAR, *EVM, *EXCHANGE]

# How a category moves a pool.
KINDS = {
    "acquire": ("income", "reward", "airdrop", "interest", "buy", "nft_sale"), "dispose": ("sell", "capital_gain", "capital_loss"),
    "in": ("deposit", "transfer_in", "unstake", "collateral_out", "liquidity_out", "loan_borrow"), "out": ("withdrawal", "transfer_out", "stake", "collateral_in", "liquidity_in", "loan_repay"),
}
SKIPPED = ("spam", "transfer", "internal_transfer")
