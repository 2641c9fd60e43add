"""The rule registry: 185 typology rules as fixed metadata."""

# Id, name, lens tags, required inputs, off-chain inputs.
RULE_TABLE = [
    (1, "CashStructuring", "behavioral,temporal", "amount,timestamp", ""),
    (2, "CashIntensiveFrontBusiness", "behavioral", "", "revenue_data"),
    (3, "ComminglingRetailTills", "behavioral", "", "pos_data"),
    (4, "MuleDeposits", "behavioral,entity", "deposit_patterns", ""),
    (5, "RoundDollarDeposits", "behavioral", "amount", ""),
    (6, "RapidCashInWireOut", "behavioral,temporal", "amount,timestamp", ""),
    (7, "CashPurchaseMonetaryInstruments", "behavioral,offramp", "", "instrument_data"),
    (8, "SequentialMoneyOrders", "behavioral", "", "instrument_data"),
    (9, "TravelerCheckCycling", "behavioral", "", "instrument_data"),
    (10, "CasinoChipWalking", "behavioral,offramp", "", "gaming_data"),
    (11, "CasinoCageFunneling", "behavioral,offramp", "", "gaming_data"),
    (12, "CurrencyExchangeLayering", "behavioral,graph", "", "forex_data"),
    (13, "BulkCashSmuggling", "behavioral,offramp", "", "customs_data"),
    (14, "CashCourierNetworks", "entity,graph", "", "courier_data"),
    (15, "NightDepositoryAbuse", "behavioral,temporal", "", "deposit_data"),
    (16, "ATMCashRecycling", "behavioral,temporal", "", "atm_data"),
    (17, "LoanBackScheme", "graph,entity", "", ""),
    (18, "CashPayrollPadding", "behavioral", "", "payroll_data"),
    (19, "CharityDonationLaundering", "behavioral,entity", "", "donation_data"),
    (20, "FestivalCashInflation", "behavioral,temporal", "", "event_data"),
    (21, "NestedPersonalAccounts", "entity,graph", "", ""),
    (22, "FunnelAccounts", "graph,behavioral", "", ""),
    (23, "PassThroughAccounts", "graph,behavioral", "", ""),
    (24, "ThirdPartyWireChain", "graph,entity", "", "wire_data"),
    (25, "BackToBackLoans", "graph,entity", "", "loan_data"),
    (26, "MirrorTransfers", "graph,temporal", "", ""),
    (27, "CorrespondentBankingAbuse", "graph,entity", "", "correspondent_data"),
    (28, "ShellCompanyInvoice", "entity", "", "invoice_data"),
    (29, "PhantomConsultingFees", "entity", "", "invoice_data"),
    (30, "IntercompanyLoanChurn", "graph,entity", "", "loan_data"),
    (31, "DormantAccountActivation", "temporal,behavioral", "", ""),
    (32, "StudentElderlyMuleAccounts", "entity,behavioral", "", "demographic_data"),
    (33, "PrepaidCardLoadingRings", "behavioral,offramp", "", "card_data"),
    (34, "GiftCardMonetization", "behavioral,offramp", "", "card_data"),
    (35, "ACHMicroSplitting", "behavioral,temporal", "", ""),
    (36, "CheckKiting", "behavioral,temporal", "", "check_data"),
    (37, "MobileDepositDuplication", "behavioral", "", "mobile_deposit_data"),
    (38, "PayrollProcessorAbuse", "entity", "", "payroll_data"),
    (39, "FintechAccountHopping", "behavioral,temporal", "", "fintech_data"),
    (40, "MicrobusinessMerchantAbuse", "entity", "", "merchant_data"),
    (41, "OverInvoicingImports", "entity", "", "trade_data"),
    (42, "UnderInvoicingExports", "entity", "", "trade_data"),
    (43, "MultipleInvoicing", "entity", "", "trade_data"),
    (44, "ShortShipping", "entity", "", "shipping_data"),
    (45, "OverShipping", "entity", "", "shipping_data"),
    (46, "PhantomShipment", "entity", "", "shipping_data"),
    (47, "MisdescriptionOfGoods", "entity", "", "customs_data"),
    (48, "CarouselTradeFraud", "graph", "", "trade_data"),
    (49, "DualUseHighValueGoods", "entity", "", "trade_data"),
    (50, "CommoditySwaps", "entity", "", "commodity_data"),
    (51, "FreightOverbilling", "entity", "", "logistics_data"),
    (52, "FalseReturnsRebates", "behavioral", "", "returns_data"),
    (53, "CustomsBrokerCollusion", "entity", "", "customs_data"),
    (54, "WarehouseReceiptFraud", "entity", "", "warehouse_data"),
    (55, "TradeFinanceLCAbuse", "entity", "", "lc_data"),
    (56, "SanctionedRouteTransshipment", "entity,graph", "", "shipping_data"),
    (57, "UsedCarExportLaundering", "offramp", "", "vehicle_data"),
    (58, "ScrapMetalValueMasking", "entity", "", "commodity_data"),
    (59, "PreciousStonePortability", "offramp", "", "gemstone_data"),
    (60, "ArtworkValuationInflation", "entity", "", "auction_data"),
    (61, "LayeredShellCompanies", "entity,graph", "", "corporate_data"),
    (62, "ShelfCompanyPurchase", "entity", "", "corporate_data"),
    (63, "NomineeShareholderMasking", "entity", "", "corporate_data"),
    (64, "TrustFoundationOpacity", "entity", "", "trust_data"),
    (65, "ProfessionalEnablerRouting", "entity,graph", "", "professional_data"),
    (66, "FalseShareholderLoans", "entity", "", "loan_data"),
    (67, "CapitalContributionRecycling", "entity,graph", "", "corporate_data"),
    (68, "DirectorForHireNetworks", "entity", "", "director_data"),
    (69, "VirtualOfficeShelling", "entity", "", "address_data"),
    (70, "InvoiceFactories", "entity", "", "invoice_data"),
    (71, "BookkeepingWashEntries", "entity", "", "accounting_data"),
    (72, "TaxRefundLaundering", "behavioral", "", "tax_data"),
    (73, "InsurancePremiumOverpayment", "behavioral", "", "insurance_data"),
    (74, "MortgageEarlyPayoff", "behavioral,offramp", "", "mortgage_data"),
    (75, "RealEstateFlippingRing", "entity,graph", "", "property_data"),
    (76, "RenovationInvoiceInflation", "entity", "", "construction_data"),
    (77, "LuxuryAssetParking", "offramp", "", "asset_data"),
    (78, "PawnAuctionLaundering", "offramp,behavioral", "", "auction_data"),
    (79, "FranchiseFeeLaundering", "entity", "", "franchise_data"),
    (80, "CrowdfundingAbuse", "behavioral,entity", "", "crowdfunding_data"),
    (81, "HawalaIVTS", "entity,graph", "", "ivts_data"),
    (82, "UndergroundBankingMirrorBooks", "entity,graph", "", "banking_data"),
    (83, "TourismReceiptInflation", "behavioral", "", "tourism_data"),
    (84, "RemittanceCorridorLayering", "graph,entity", "", "remittance_data"),
    (85, "RefugeeAidDiversion", "entity", "", "aid_data"),
    (86, "DiplomaticPouchAbuse", "entity", "", "diplomatic_data"),
    (87, "FreeTradeZoneConcealment", "entity", "", "ftz_data"),
    (88, "CashForGoldExportLoop", "offramp,graph", "", "commodity_data"),
    (89, "CrossBorderSalarySimulation", "entity", "", "payroll_data"),
    (90, "StudentTuitionLaundering", "entity", "", "tuition_data"),
    (91, "PeelChain", "graph,temporal,behavioral", "", ""),
    (92, "FanOutDispersal", "graph,temporal", "", ""),
    (93, "FanInAggregation", "graph,temporal", "", ""),
    (94, "LayeredHopsFreshWallets", "graph,behavioral", "", ""),
    (95, "DustingMixedInflows", "graph,behavioral", "", ""),
    (96, "SelfTransferChain", "entity,graph", "", ""),
    (97, "AddressHoppingBlacklists", "graph,behavioral", "", ""),
    (98, "TimeDelayLayering", "temporal,behavioral", "", ""),
    (99, "MicroSplittingThresholds", "behavioral,temporal", "", ""),
    (100, "ConsolidationAfterObfuscation", "graph", "", ""),
    (101, "ChangeAddressAbuse", "graph,behavioral", "", ""),
    (102, "CoinJoinParticipation", "graph,entity", "", ""),
    (103, "CentralizedMixerUse", "graph,offramp", "", "mixer_data"),
    (104, "DecentralizedMixingPools", "graph", "", "mixing_pool_data"),
    (105, "CrossWalletChainLoops", "graph,behavioral", "", ""),
    (106, "OTCBrokerLayering", "graph,offramp", "", "otc_data"),
    (107, "BridgeHopObfuscation", "graph,offramp", "", "bridge_data"),
    (108, "CrossChainSwapHops", "graph", "", "swap_data"),
    (109, "StablecoinWrapping", "graph,behavioral", "", ""),
    (110, "GasSponsorshipDistancing", "entity,graph", "", ""),
    (111, "PrivacyCoinConversion", "graph,offramp", "", "privacy_coin_data"),
    (112, "ShieldedPoolEntryExit", "graph", "", "shielded_pool_data"),
    (113, "AnonymityWalletRouting", "graph", "", "wallet_type_data"),
    (114, "StealthAddressCycling", "graph,entity", "", "stealth_data"),
    (115, "RingSignatureLaundering", "graph", "", "ring_sig_data"),
    (116, "SwapInOutPrivacyAssets", "graph,offramp", "", "swap_data"),
    (117, "AtomicSwapPrivacyHop", "graph", "", "atomic_swap_data"),
    (118, "MixToBridgeSequence", "graph,offramp", "", "mixer_data,bridge_data"),
    (119, "WalletClusterFragmentation", "entity,graph", "", ""),
    (120, "TokenizedGiftCardCashout", "offramp,behavioral", "", "gift_card_data"),
    (121, "DEXWashPathing", "graph,behavioral", "", "dex_data"),
    (122, "DEXAggregatorChurn", "graph", "", "dex_data"),
    (123, "LiquidityPoolParking", "graph,behavioral", "", "defi_data"),
    (124, "FlashLoanCamouflage", "graph,behavioral", "", "defi_data"),
    (125, "MEVBundleShielding", "graph", "", "mev_data"),
    (126, "YieldFarmLaundering", "graph,behavioral", "", "defi_data"),
    (127, "LendingProtocolBorrowLoop", "graph,behavioral", "", "defi_data"),
    (128, "LiquidationEventMasking", "graph", "", "defi_data"),
    (129, "BridgeAndDEXDaisyChain", "graph,offramp", "", "bridge_data,dex_data"),
    (130, "CrossChainRouterAbuse", "graph", "", "router_data"),
    (131, "GovernanceTokenFlipping", "graph,behavioral", "", ""),
    (132, "NFTWashSaleLaundering", "behavioral,entity,offramp", "", ""),
    (133, "NFTRoyaltyRecycling", "behavioral,entity", "", ""),
    (134, "LowLiquidityTokenPumping", "behavioral,graph", "", ""),
    (135, "AirdropFarmingDisguise", "entity,graph", "", ""),
    (136, "StablecoinMintRedeemCycling", "graph,behavioral", "", ""),
    (137, "Layer2InOutHopping", "graph", "", "l2_data"),
    (138, "CrossProtocolCollateralRelay", "graph,behavioral", "", "defi_data"),
    (139, "DAOTreasuryAbuse", "graph,entity", "", "dao_data"),
    (140, "OnChainGameAssetLaundering", "behavioral,graph", "", "gaming_data"),
    (141, "ExchangeAccountMuleRing", "entity,offramp", "", ""),
    (142, "NestedVASPExposure", "graph,offramp", "", ""),
    (143, "KYCBorrowedAccountCashout", "entity,offramp", "", "kyc_data"),
    (144, "P2PExchangeLaundering", "graph,offramp", "", ""),
    (145, "CryptoATMCashout", "offramp,temporal", "", "atm_data"),
    (146, "PrepaidDebitOfframp", "offramp", "", "card_data"),
    (147, "MerchantProcessorOfframp", "offramp", "", "merchant_data"),
    (148, "OTCSettlementTradeInvoices", "offramp", "", "invoice_data"),
    (149, "CrossBorderExchangeArbitrage", "offramp,behavioral", "", ""),
    (150, "ForeignExchangeHouseCashout", "offramp", "", "fex_data"),
    (151, "PayrollGigCashoutCryptoTreasury", "offramp,entity", "", "payroll_data"),
    (152, "InvoiceFinancingOfframp", "offramp", "", "invoice_data"),
    (153, "RealEstateDownPaymentExchange", "offramp", "", "property_data"),
    (154, "LuxuryDealerCryptoAcceptance", "offramp", "", "dealer_data"),
    (155, "CharityNGOCryptoDonation", "offramp,entity", "", "ngo_data"),
    (156, "SyntheticIdentityAccountOpening", "entity", "", "kyc_data"),
    (157, "DeepfakeKYCInterviews", "entity", "", "biometric_data"),
    (158, "MassMuleRecruitmentGenAI", "entity", "", "outreach_data"),
    (159, "AIGeneratedShellWebsites", "entity", "", "domain_data"),
    (160, "AIWrittenInvoicesContracts", "entity", "", "invoice_contract_metadata"),
    (161, "AutomatedTransactionScheduling", "temporal,behavioral", "", ""),
    (162, "ReinforcementLearnedThresholdAvoidance", "temporal,behavioral", "", ""),
    (163, "GraphAwareRouteOptimization", "graph,behavioral", "", ""),
    (164, "BotnetWalletOrchestration", "entity,temporal,graph", "", ""),
    (165, "AutonomousCrossChainExecution", "graph,temporal", "", ""),
    (166, "AICustomerServiceSocialEngineering", "entity", "", "support_data"),
    (167, "VoiceCloningPaymentApproval", "entity", "", "voice_data"),
    (168, "ImageForgeryFinancialRecords", "entity", "", "filing_image_metadata"),
    (169, "AutomatedAccountRecoveryTakeover", "entity,temporal", "", "auth_data"),
    (170, "AIPersonalizedMuleCoaching", "entity", "", "comm_data"),
    (171, "SyntheticBeneficialOwnerNarratives", "entity", "", "narrative_data"),
    (172, "AdversarialBehaviorAgainstAMLModels", "behavioral,temporal", "", ""),
    (173, "AIGeneratedScamFronts", "entity,graph", "", "scam_data"),
    (174, "AutonomousOTCNegotiationBots", "offramp,temporal", "", "otc_data"),
    (175, "MultiAgentLaunderingWorkflow", "graph,entity,temporal", "", ""),
    (176, "SanctionsEvasionStablecoinCorridor", "offramp,graph,entity", "", ""),
    (177, "MerchantTradeSettlementCrypto", "offramp", "", "trade_data"),
    (178, "StateProxyExchangeNetworks", "entity,graph", "", "sanctions_data"),
    (179, "RansomwareProceedsLayering", "graph,offramp", "", ""),
    (180, "PigButcheringScamTreasury", "graph,entity,offramp", "", ""),
    (181, "DarknetMarketplaceSettlement", "graph,offramp", "", ""),
    (182, "CSAMPaymentLaundering", "graph", "", ""),
    (183, "FraudRingSettlementTokenTransfers", "graph,entity,offramp", "", ""),
    (184, "TerrorFinanceMicroTransferWebs", "graph,temporal,entity", "", ""),
    (185, "HumanTraffickingRemittanceLaundering", "graph,offramp,entity", "", ""),
]

# Last rule id of each environment block.
ENVIRONMENT_BLOCKS = [(90, "traditional"), (142, "blockchain"), (155, "hybrid"), (175, "ai_enabled"), (185, "hybrid")]
