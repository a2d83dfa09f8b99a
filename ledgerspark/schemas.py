"""Schemas of raw input. Every field is read as text or raw JSON first; types follow by checked conversion."""

ENVELOPE = "jsonrpc string, id string, result string, error struct<code:int,message:string>"
EVM_BLOCK = "number string, hash string, parentHash string, timestamp string, transactions array<string>"
EVM_TX = "hash string, `from` string, `to` string, value string, gasPrice string, input string"
EVM_RECEIPT = "transactionHash string, blockNumber string, blockHash string, status string, gasUsed string, transactionIndex string, logs array<string>"
EVM_LOG = "transactionHash string, blockNumber string, address string, topics array<string>, data string, logIndex string, transactionIndex string"
TRON_BLOCK = "blockID string, blockNumber bigint, blockWitness string, parentHash string, timestamp bigint, transactions array<string>"
TRON_TX = "txID string, blockNumber bigint, blockHash string, fromAddress string, toAddress string, value decimal(38,0), gasPrice decimal(38,0), gasUsed bigint, status boolean, contractData string, logs array<struct<address:string,topics:array<string>,data:string>>"
SOLANA_BLOCK = "slot bigint, parentSlot bigint, blockhash string, previousBlockhash string, blockTime bigint, transactions array<string>"
SOLANA_TX = "signature string, slot bigint, meta struct<err:string,fee:bigint,logMessages:array<string>>"
DEAD_LETTER = "message string, reason string, time timestamp"
#: Common rows of all chain types.
BLOCKS = "chain_id string, block_number bigint, block_hash string, parent_hash string, block_ts timestamp"
TRANSACTIONS = "chain_id string, tx_hash string, block_number bigint, block_hash string, tx_index bigint, from_address string, to_address string, value_hex string, value_wei decimal(38,0), gas_price decimal(38,0), status string"
LOGS = "chain_id string, tx_hash string, block_number bigint, tx_index bigint, log_index bigint, address string, topics array<string>, data string"
